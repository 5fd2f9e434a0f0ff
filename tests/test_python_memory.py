"""Python tasks hold a batch of contents once, as Arrow gives it."""

import tracemalloc

import pyarrow as pa

from auditlake.functions import prefilter as PF
from auditlake.operators import symbols as SY

GROUPS = (("needle",), ("other", "needle"))


def peak_of(work) -> int:
    work()  # imports and caches
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_literals_are_looked_for_text_by_text():
    texts = pa.array(["x" * 99_990 + "needle"] * 100 + ["other", "", None])
    assert peak_of(lambda: PF.answers_of(GROUPS, texts)) < 2 << 20  # the texts are 10 MB
    assert [r["w0"] for r in PF.answers_of(GROUPS, texts).to_pylist()] == [3] * 100 + [2, 0, 0]
    assert len(PF.answers_of(GROUPS, texts.slice(0, 0))) == 0


def test_sources_are_parsed_file_by_file():
    source = "import os\n" + "#" * 99_990
    batch = pa.RecordBatch.from_pydict({"workspace": ["w"] * 100, "path": ["p"] * 100, "content": pa.array([source] * 100)})
    assert peak_of(lambda: list(SY._symbols(iter([batch])))) < 4 << 20
    (found,) = SY._symbols(iter([batch]))
    assert found.to_pylist() == [{"workspace": "w", "path": "p", "kind": "import", "symbol": "os", "lineno": 1, "nearby": ""}] * 100
    assert [b.num_rows for b in SY._symbols(iter([batch.slice(0, 0)]))] == [0]
