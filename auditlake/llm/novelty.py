"""Operator 12, secret scans by dictionary-primed zstandard novelty.

Plain patterns give the base spans. Further candidates are long runs of key characters shortly after a sensitive word in the
same line. A candidate's novelty is what it adds to the compressed size of its surroundings (text before and behind it,
other occurrences of it left out), in bits a byte, with a compressor primed by a dictionary of identifiers: the
words that most documents have around sensitive words, gathered by Spark over all documents, and common code words.
Identifiers, paths and prose are in the dictionary or the surroundings and add little; random strings can't be shortened, and from
``THRESHOLD`` bits a byte on they are reported.

Texts are searched as chunks of bytes: sensitive words by substring search, runs of hex digits on the byte array,
and patterns only where their first word is. The cost is linear in the text; a candidate is compressed with ``AROUND`` bytes on
either side.

Cases: null and empty texts have no spans. Repeated rows and rows with a null id each get their spans. Offsets are code points, ends exclusive,
spans sorted by start, then kind. Candidates that overlap a base span are passed over. In an empty table, or
one without sensitive words, the dictionary holds the code words alone. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import Chunk, batches, chunks, column, ddl, only, rows

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
#: base patterns: first words of an assignment, the assignment, keys by prefix, runs of hex digits, and least lengths
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: words that make what follows them sensitive
SENSITIVE = (b"password", b"passwd", b"pwd", b"secret", b"token", b"api key", b"apikey", b"api_key", b"api-key", b"auth", b"bearer", b"credential",
             b"private key", b"private_key", b"access key", b"access_key", b"signature", b"session", b"cookie", b"license key", b"webhook")
#: code words that the dictionary always has
CODE = ("import return function class const public private static string integer boolean null true false self this export default "
        "async await config settings environment variable getenv process request response header authorization content application "
        "json client server service database connection username password secret token access refresh session cookie signature "
        "credential certificate public_key private_key access_key secret_key api_key client_id client_secret bucket region endpoint "
        "https http localhost example com www path file name value key data user admin test").split()
#: candidates: runs of key characters that start within REACH bytes behind a sensitive word
REACH, AROUND, PIECE = 120, 128, 1024
RUN = re.compile(rb"(?<![A-Za-z0-9+/_~.-])[A-Za-z0-9+/_~-][A-Za-z0-9+/_~.-]{15,}={0,2}")
IDENTIFIER = re.compile(rb"(?<![A-Za-z0-9+/_~=-])[A-Za-z_]{3,24}(?![A-Za-z0-9+/_~=-])")
#: identifiers in the dictionary (100 kB at most), documents an identifier is in at least
IDENTIFIERS, DOCUMENTS = 4096, 2
LEVEL = 19
#: bits a byte from which on a candidate is reported
THRESHOLD = 6.2
WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
SPANS = "ARRAY<STRUCT<kind: INT, start: BIGINT, end: BIGINT, bits: DOUBLE>>"
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def _places(raw: bytes, words: tuple[bytes, ...]) -> list[int]:
    """Starts of all occurrences of the words, in order."""
    out = []
    for w in words:
        at = raw.find(w)
        while at >= 0:
            out.append(at)
            at = raw.find(w, at + 1)
    return sorted(out)


def _base_spans(c: Chunk, raw: bytes, lower: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the chunk; a match that fails a test is dropped and its text not tried again."""
    out = []
    done = 0
    for at in _places(lower, ASSIGN_WORDS):
        if at >= done and (m := ASSIGN.match(raw, at)):
            done = m.end()
            if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                out.append((at, 0, done))
    done = 0
    for at in _places(raw, (b"AKIA",)):
        if at >= done and (m := ACCESS.match(raw, at)):
            done = m.end()
            if done - at >= ACCESS_LEAST:
                out.append((at, 1, done))
    inside = np.zeros(len(c.data) + 2, bool)
    inside[1:-1] = _IS_HEX[c.data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    long_enough = ends - starts >= HEX_LEAST
    out += [(s, 2, e) for s, e in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True)]
    return sorted(out)


def _windows(c: Chunk, raw: bytes, lower: bytes) -> list[tuple[int, int]]:
    """Byte ranges behind sensitive words, to the end of the line at most (a line end separates texts), without overlaps."""
    out: list[list[int]] = []
    for at in _places(lower, SENSITIVE):
        line = raw.find(b"\n", at, at + REACH)
        end = min(at + REACH, len(raw)) if line < 0 else line
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return [(a, b) for a, b in out]


def _candidates(raw: bytes, windows: list[tuple[int, int]], base: list[tuple[int, int, int]]):
    """(start, end) of runs that start in a window and meet no base span."""
    taken_start = np.array([s for s, _, _ in base], np.int64)
    taken_end = np.maximum.accumulate([e for _, _, e in base]) if base else np.zeros(0, np.int64)
    done = 0
    for lo, hi in windows:
        at = max(lo, done)
        while at < hi and (m := RUN.search(raw, at, hi + 16)) and m.start() < hi:
            m = RUN.match(raw, m.start())  # to its end
            at = done = m.end()
            start, end = m.start(), m.start() + len(m.group().rstrip(b".-"))
            before = np.searchsorted(taken_start, end)  # base spans that start before the end
            if end - start >= 16 and not (before and taken_end[before - 1] > start):
                yield start, end


def primed(identifiers: list[str], level: int = LEVEL) -> zstandard.ZstdCompressor:
    """Compressor with a dictionary of words, the commonest last."""
    words = zstandard.ZstdCompressionDict(" ".join([*reversed(identifiers), *CODE]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(compressor: zstandard.ZstdCompressor, candidate: bytes, before: bytes, behind: bytes) -> float:
    """Bits a byte that the candidate adds to its surroundings.

    Block headers and code tables change by whole bytes, so this is the mean over the text before it, behind it and both, each with the
    candidate at its end and at its start. Long candidates are measured in pieces, so that the cost stays linear.
    """
    size = lambda text: len(compressor.compress(text))
    before, behind = before.replace(candidate, b""), behind.replace(candidate, b"")
    pieces = [candidate[i : i + PIECE] for i in range(0, len(candidate), PIECE)]
    more = sum(size(around + x) + size(x + around) - 2 * size(around) for around in (before, behind, before + behind) for x in pieces)
    return 8.0 * more / (6 * len(candidate))


def _identifiers():
    """Tasks' function: words around sensitive words, and the number of texts that have them."""
    def run(it):
        for batch in batches(it):
            for c in chunks(column(batch, "text"), b"\n"):
                raw = c.data.tobytes()
                seen: dict[int, set] = {}
                for lo, hi in _windows(c, raw, raw.lower()):
                    t = int(c.text_of(np.array([lo]))[0])
                    first, last = max(int(c.at[t]), lo - AROUND), min(int(c.at[t] + c.lengths[t]), hi + AROUND)
                    seen.setdefault(t, set()).update(IDENTIFIER.findall(raw, first, last))
                count = Counter(w for words in seen.values() for w in words)
                yield rows(WORDS, word=[w.decode() for w in count], n=list(count.values()))
    return run


def dictionary(docs: DataFrame, *, text_col: str = "text", most: int = IDENTIFIERS) -> list[str]:
    """The identifiers around sensitive words that most documents have, ``most`` at most, commonest first."""
    found = only(docs, text=text_col).mapInArrow(_identifiers(), ddl(WORDS)).groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in found.where(F.col("n") >= DOCUMENTS).orderBy(F.desc("n"), "word").limit(most).collect()]


def _spans(identifiers: list[str], threshold: float):
    """Tasks' function: ids and spans."""
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def of_chunk(c: Chunk, compressor) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(c.n)]
        raw = c.data.tobytes()
        lower = raw.lower()
        base = _base_spans(c, raw, lower)
        found = [(s, kind, e, None) for s, kind, e in base]
        for start, end in _candidates(raw, _windows(c, raw, lower), base):
            t = int(c.text_of(np.array([start]))[0])
            first, last = int(c.at[t]), int(c.at[t] + c.lengths[t])
            bits = novelty(compressor, raw[start:end], raw[max(first, start - AROUND) : start], raw[end : min(last, end + AROUND)])
            if bits >= threshold:
                found.append((start, 3, end, bits))
        if found:
            found.sort(key=lambda x: x[:2])
            points = np.zeros(len(c.data) + 1, np.int64)
            np.cumsum((c.data & 0xC0) != 0x80, out=points[1:])
            owner = c.text_of(np.array([x[0] for x in found]))
            for (start, kind, end, bits), t in zip(found, owner.tolist(), strict=True):
                zero = int(points[c.at[t]])
                out[t].append({"kind": kind, "start": int(points[start]) - zero, "end": int(points[end]) - zero, "bits": bits})
        return out

    def run(it):
        compressor = primed(identifiers)
        for batch in batches(it):
            spans = [s for c in chunks(column(batch, "text"), b"\n") for s in of_chunk(c, compressor)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(spans, kinds)], names=["id", "secrets"])
    return run


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, identifiers: list[str] | None = None) -> DataFrame:
    """(id, secrets): one row per document, spans as (kind: index in ``KINDS``, start, end, bits of novelty)."""
    texts = only(docs, id=id_col, text=text_col)
    known = dictionary(docs, text_col=text_col) if identifiers is None else identifiers
    return texts.mapInArrow(_spans(known, threshold), f"id {dict(texts.dtypes)['id']}, secrets {SPANS}")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(id, text): spans replaced by their kind; where spans overlap, the first one counts and the rest of the others goes too."""
    texts = only(docs, id=id_col, text=text_col)
    known = dictionary(docs, text_col=text_col)
    scan = _spans(known, options.get("threshold", THRESHOLD))

    def run(it):
        for batch in batches(it):
            spans = next(scan(iter([batch]))).column(1).to_pylist()
            out = []
            for text, found in zip(column(batch, "text").to_pylist(), spans, strict=True):
                pieces, done = [], 0
                for s in found:
                    if s["start"] >= done:
                        pieces += [text[done : s["start"]], f"[{KINDS[s['kind']]}]"]
                    done = max(done, s["end"])
                out.append(None if text is None else "".join(pieces) + text[done:])
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(out, pa.string())], names=["id", "text"])
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, text STRING")
