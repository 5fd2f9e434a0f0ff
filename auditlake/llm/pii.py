"""Operator 10, personal data by boosted candidate spans, in DataFrame functions alone.

Base spans (email, ip, card, phone) are found by their patterns and checked by their rules. High-recall generators
propose further, overlapping spans: address-like, number-like, token-like, and values assigned to telling names. Each
candidate gets eight small whole-number features of its format and context. Boosted trees of depth two are fitted on
candidates whose label is sure (they overlap a base span, carry a known key prefix, or are assigned to a telling name;
all others count as ordinary); candidates that look alike are scored alike, so keys and numbers without sure signs are
found too. The threshold is calibrated on the half of the documents that the trees have not seen: the lowest score at
which ``PRECISION`` of the weakly labelled candidates above are positive.

All candidates of all documents are counted into at most 27,648 combinations of features; this bounded table alone is
collected, and the fitted trees become one SQL expression.

Patterns are written with possessive quantifiers, which match the same and never recurse, and start either where the
previous match ended or at the head of a run, so long runs of letters or digits cost linear time.

Cases: null and empty texts have no spans. Rows are taken one by one, repeated or not. Without candidates of both
labels nothing is added to the base spans. Extra columns are kept by ``redact`` and never read. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from .common import only

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "number", "token", "assigned")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "address": r"(?:\G|(?<![^\s@<>(),;:\"]))[^\s@<>(),;:\"]++(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>(),;:\"]++",
    "number": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20()./-]{1,2}+[0-9]++)*+",
    "token": r"(?:\G|(?<![A-Za-z0-9_/+-]))(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{12,}+",
    "assigned": r"(?i)(?<![a-z])(?:passw(?:or)?d|pwd|token|secret|api_?key)[\"']?\x20?[:=]\x20?[\"']?[^\s\"',;]{4,}+",
}
#: what a text must contain for a pattern to be tried
NEEDED = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "address": r"@|[\[(]at[\])]", "number": "[0-9]", "token": "[0-9]", "assigned": "[:=]"}
KEY_PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-)"
TELLING = r"(?i)(?:mail|phone|tel|call|card|visa|iban|ssn|passw|token|secret|key|address|account)"
FEATURES = {"kind": 4, "length": 6, "digits": 6, "cases": 4, "separators": 4, "telling": 2, "before": 3, "hex": 2}
ROUNDS, RATE, PRECISION, PRIOR = 24, 0.4, 0.9, 1.0
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _matches(text: Column, kind: str) -> Column:
    """(start, end, s) of the matches of a pattern: the lengths of the pieces between them give their places."""
    found = F.regexp_extract_all(text, F.lit(f"({PATTERNS[kind]})"), F.lit(1))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.length(g).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,s:string>>").alias("out"))

    def step(acc, pair):
        at = acc["at"] + pair["gap"]
        end = at + F.length(pair["s"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), pair["s"].alias("s")))).alias("out"))

    zipped = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), lambda s, g: F.struct(s.alias("s"), g.alias("gap")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,s:string>>")
    return F.when(text.rlike(NEEDED[kind]), F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)


def _digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


def _passes(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _digits(s).between(12, 19) & F.call_function("luhn_check", F.regexp_replace(s, "[^0-9]", ""))
    return _digits(s).between(9, 15) if kind == "phone" else F.lit(True)


def _binned(value: Column, *edges: int) -> Column:
    out = F.lit(len(edges))
    for at in range(len(edges) - 1, -1, -1):
        out = F.when(value < edges[at], at).otherwise(out)
    return out


def _overlaps(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def with_spans(docs: DataFrame, text_col: str, prefix: str = "pii") -> DataFrame:
    """``docs`` plus ``{prefix}_base`` (base spans) and ``{prefix}_more`` (candidates that overlap none, and those that
    overlap one, with features and weak label)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def checked(kind: str) -> Column:
        good = F.filter(_matches(text, kind), lambda m: _passes(kind, m["s"]))
        return F.transform(good, lambda m: F.struct(m["start"], F.lit(KINDS.index(kind)).alias("kind"), m["end"]))

    def proposed(kind: str) -> Column:
        return F.transform(_matches(text, kind), lambda m: F.struct(m["start"], F.lit(KINDS.index(kind)).alias("kind"), m["end"], m["s"]))

    base = F.concat(*map(checked, BASE)).cast(SPAN)
    found = F.concat(*map(proposed, KINDS[len(BASE):]))

    def features(c: Column) -> Column:
        s = c["s"]
        left = F.substring(text, F.greatest(c["start"] - 15, F.lit(1)).cast("int"), F.least(c["start"], F.lit(16)).cast("int"))
        has_upper, has_lower = s.rlike("[A-Z]").cast("int"), s.rlike("[a-z]").cast("int")
        return F.struct(
            (c["kind"] - len(BASE)).alias("kind"), _binned(F.length(s), 8, 12, 16, 20, 32).alias("length"), _binned(_digits(s), 1, 4, 9, 12, 16).alias("digits"),
            (has_upper + 2 * has_lower).alias("cases"), _binned(F.length(F.regexp_replace(s, r"[^\x20().:/=+_-]", "")), 1, 2, 4).alias("separators"),
            left.rlike(TELLING).cast("int").alias("telling"), F.when(left.rlike(r"(?:^|\s)$"), 0).when(left.rlike("[\"'=:(<\\[]$"), 1).otherwise(2).alias("before"),
            s.rlike("^[0-9a-f]+$").cast("int").alias("hex"))

    base_name, more_name, raw = f"{prefix}_base", f"{prefix}_more", f"{prefix}_raw"
    named = docs.withColumn(base_name, base).withColumn(raw, found)
    more = F.transform(F.col(raw), lambda c: F.struct(
        c["start"], c["kind"], c["end"], features(c).alias("f"), _overlaps(F.col(base_name), c).alias("known"),
        (c["s"].rlike(KEY_PREFIX) | (c["kind"] == KINDS.index("assigned"))).alias("sure")))
    return named.withColumn(more_name, more).drop(raw)


class Boosted:
    """Trees (feature, edge, then for each side feature, edge, and two leaves) and a threshold; None: nothing is added."""

    def __init__(self, start: float, trees: list, threshold: float | None):
        self.start, self.trees, self.threshold = start, trees, threshold

    def score(self, f: Column) -> Column:
        total = F.lit(self.start)
        for name, edge, sides in self.trees:
            low, high = (F.when(f[n] <= e, a).otherwise(b) for n, e, a, b in sides)
            total = total + F.when(f[name] <= edge, low).otherwise(high)
        return total

    def value(self, f: dict) -> float:
        total = self.start
        for name, edge, sides in self.trees:
            n, e, a, b = sides[0] if f[name] <= edge else sides[1]
            total += a if f[n] <= e else b
        return total


def _split(cells: list) -> tuple:
    """The best split of cells (features, gradient, curvature): (gain, name, edge)."""
    g_all, h_all = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (0.0, "kind", FEATURES["kind"])
    for name, values in FEATURES.items():
        g, h = [0.0] * values, [0.0] * values
        for f, cg, ch in cells:
            g[f[name]] += cg
            h[f[name]] += ch
        gl = hl = 0.0
        for edge in range(values - 1):
            gl, hl = gl + g[edge], hl + h[edge]
            gain = gl * gl / (hl + PRIOR) + (g_all - gl) ** 2 / (h_all - hl + PRIOR) - g_all * g_all / (h_all + PRIOR)
            if gain > best[0] + 1e-9:
                best = (gain, name, edge)
    return best


def boost(cells: list[tuple[dict, float, float]], held: list[tuple[dict, float, float]]) -> Boosted:
    """Fit trees on cells (features, positives, negatives), and the threshold on held-out cells."""
    positive, negative = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not positive or not negative or not sum(c[1] for c in held):
        return Boosted(0.0, [], None)
    model = Boosted(log(positive / negative), [], None)
    scores = [model.start] * len(cells)
    for _ in range(ROUNDS):
        probability = [1 / (1 + exp(-max(-30.0, min(30.0, s)))) for s in scores]
        work = [(f, p * (1 - q) - n * q, (p + n) * q * (1 - q)) for (f, p, n), q in zip(cells, probability, strict=True)]
        _, name, edge = _split(work)
        sides = []
        for side in ([w for w in work if w[0][name] <= edge], [w for w in work if w[0][name] > edge]):
            _, n, e = _split(side)
            leaf = lambda rows: RATE * sum(r[1] for r in rows) / (sum(r[2] for r in rows) + PRIOR)
            sides.append((n, e, leaf([w for w in side if w[0][n] <= e]), leaf([w for w in side if w[0][n] > e])))
        tree = (name, edge, sides)
        one = Boosted(0.0, [tree], None)
        model.trees.append(tree)
        scores = [s + one.value(f) for s, (f, _, _) in zip(scores, cells, strict=True)]
    ranked = sorted(((model.value(f), p, n) for f, p, n in held), key=lambda x: -x[0])
    taken_p = taken = 0.0
    for at, (s, p, n) in enumerate(ranked):
        taken_p, taken = taken_p + p, taken + p + n
        last = at + 1 == len(ranked) or ranked[at + 1][0] < s
        if last and taken_p >= PRECISION * taken:
            model.threshold = s - 1e-9
    return model


def fit(spans: DataFrame, id_col: str, prefix: str = "pii") -> Boosted:
    """Count the candidates of ``with_spans`` by features and weak label, and boost trees over the counts."""
    counts = (
        spans.select(F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(2)).alias("half"), F.explode(f"{prefix}_more").alias("c"))
        .select("half", "c.f.*", (F.col("c.known") | F.col("c.sure")).alias("positive"))
        .groupBy("half", *FEATURES).agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n"))
    )
    halves: list[list] = [[], []]
    for r in sorted(counts.collect(), key=lambda r: tuple(r)):  # at most twice the combinations of features
        halves[r.half].append(({n: r[n] for n in FEATURES}, float(r.p), float(r.n)))
    return boost(*halves)


def with_all(spans: DataFrame, model: Boosted, prefix: str = "pii") -> DataFrame:
    """``{prefix}_spans``: base spans and the candidates that the trees accept and no base span overlaps, in order."""
    base = F.col(f"{prefix}_base")
    if model.threshold is None:
        added = F.array().cast(SPAN)
    else:
        accepted = F.filter(F.col(f"{prefix}_more"), lambda c: ~c["known"] & (model.score(c["f"]) >= model.threshold))
        added = F.transform(accepted, lambda c: F.struct(c["start"], c["kind"], c["end"])).cast(SPAN)
    return spans.withColumn(f"{prefix}_spans", F.array_sort(F.array_distinct(F.concat(base, added))))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, pii_base and pii_spans."""
    spans = durable(with_spans(only(docs, id=id_col, text=text_col), "text").drop("text"))
    return with_all(spans, fit(spans, "id")).select("id", "pii_base", "pii_spans")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by the kind of its first span, as in [EMAIL]."""
    model = fit(with_spans(only(docs, id=id_col, text=text_col), "text"), "id")
    text = F.col(f"`{text_col}`")
    upper = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.element_at(upper, s["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), gap.otherwise(acc["out"]).alias("out"))

    def close(acc):
        return F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    marked = with_all(with_spans(docs, text_col, "__pii"), model, "__pii")
    clean = F.when(F.size("__pii_spans") > 0, F.aggregate("__pii_spans", start, step, close)).otherwise(text)
    return marked.withColumn(text_col, clean).select(*(f"`{c}`" for c in docs.columns))
