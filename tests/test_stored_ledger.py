"""The stored ledger: side-by-side writers, failed writers, pruned look-ups; roots that grow against full folds."""

import datetime as dt
import hashlib
from concurrent.futures import ThreadPoolExecutor

import pytest

from auditlake.operators import finalize as FN, ledger as LG, roots as RO
from auditlake.session import durable
from auditlake.sources import ledger as LS


def sha(text):
    return hashlib.sha256(str(text).encode()).hexdigest()


def rows(spark, names):
    data = [(sha(n).upper(), "K1", ["SOC2"], float(n), dt.datetime(2024, 1, 1) + dt.timedelta(days=n)) for n in names]
    return spark.createDataFrame(data, "merkle_root STRING, public_key_hex STRING, frameworks_covered ARRAY<STRING>, control_coverage_percent DOUBLE, created_at TIMESTAMP_NTZ")


def shown(df):
    return sorted((r.id, r.merkle_root, r.public_key_hex) for r in df.collect())


def test_appends_keep_duplicates_and_number_on(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with pytest.raises(ValueError):
        LS.read_ledger(spark, path)
    assert LS.append_ledger(spark, rows(spark, []), path) == (1, 0)
    assert LS.append_ledger(spark, rows(spark, [5, 3]), path) == (1, 2)
    assert LS.append_ledger(spark, rows(spark, [3, 4]), path) == (3, 4)
    want = [(1, sha(3), "k1"), (2, sha(5), "k1"), (3, sha(3), "k1"), (4, sha(4), "k1")]
    assert shown(LS.read_ledger(spark, path)) == want
    block = LS.compact_ledger(spark, path)
    assert list(LS.live_blocks(spark, path)) == [block] and shown(LS.read_ledger(spark, path)) == want
    assert LS.compact_ledger(spark, path) is None
    assert LS.append_ledger(spark, rows(spark, [9]), path) == (5, 5) and len(shown(LS.read_ledger(spark, path))) == 5


def test_writers_side_by_side_get_distinct_consecutive_blocks(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with ThreadPoolExecutor(4) as pool:
        got = sorted(pool.map(lambda n: LS.append_ledger(spark, rows(spark, range(n)), path, 1), [3, 1, 4, 2]))
    assert sorted(last - first + 1 for first, last in got) == [1, 2, 3, 4]
    assert [i for first, last in got for i in range(first, last + 1)] == list(range(1, 11))
    assert [i for i, *_ in shown(LS.read_ledger(spark, path))] == list(range(1, 11))


def test_one_name_is_created_once(spark, tmp_path):
    path = str(tmp_path / "names" / "one")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: LS.create_once(spark, path, {"n": n}), range(16)))
    assert won.count(True) == 1 and LS._text(spark, path) == {"n": won.index(True)}
    assert LS._names(spark, str(tmp_path / "names")) == ["one"]


@pytest.mark.parametrize("step", ["_write", "_publish"])
def test_failed_writer_leaves_nothing_visible(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "ledger")
    LS.append_ledger(spark, rows(spark, [1, 2]), path)
    with monkeypatch.context() as broken:
        real = LS._write

        def lost(*args):
            if step == "_write":
                real(*args)  # files are there, the writer dies before it comes back
            raise OSError("lost")

        broken.setattr(LS, step, lost)
        with pytest.raises(OSError):
            LS.append_ledger(spark, rows(spark, [7, 8, 9]), path)
    assert [i for i, *_ in shown(LS.read_ledger(spark, path))] == [1, 2]
    assert LS.append_ledger(spark, rows(spark, [3]), path) == (6, 6)
    assert [i for i, *_ in shown(LS.read_ledger(spark, path))] == [1, 2, 6]


def test_look_up_reads_asked_folders_and_moves_no_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for part in (range(0, 300), range(200, 400)):
        LS.append_ledger(spark, rows(spark, part), path, 1)
    ledger = LS.read_ledger(spark, path).drop("block", "bucket")
    asked = spark.createDataFrame([(sha(250).upper(), "K1"), (sha(10), "other"), ("zz", "k1"), (None, "k1")], "merkle_root STRING, public_key_hex STRING")
    want = sorted(map(str, LG.auditor_verify(asked, ledger).collect()))
    assert sorted(map(str, LS.verify_stored(asked, spark, path).collect())) == want
    assert sorted(map(str, LS.verify_stored(asked, spark, path, few_keys=1).collect())) == want
    found = LS.asked_rows(asked, spark, path)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    whole = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan[plan.index("PartitionFilters"):] and "IN " in plan
    assert "BroadcastHashJoin" in whole and "LeftSemi" in whole and "hashpartitioning" not in whole
    assert shown(found) == [t for t in shown(ledger) if t[1] == sha(250)]


def test_odd_roots_and_no_requests(spark, tmp_path):
    path = str(tmp_path / "ledger")
    odd = spark.createDataFrame([("not hex", "k"), (None, "k"), ("", None)], "merkle_root STRING, public_key_hex STRING").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS created_at", "array('SOC2') AS frameworks_covered", "1.0D AS control_coverage_percent")
    LS.append_ledger(spark, odd, path)
    asked = spark.createDataFrame([("NOT HEX", "K"), ("", None)], "merkle_root STRING, public_key_hex STRING")
    got = {r.merkle_root: r.verified for r in LS.verify_stored(asked, spark, path).collect()}
    assert got == {"NOT HEX": True, "": False}
    assert LS.verify_stored(asked.limit(0), spark, path).count() == 0


def test_growing_roots_equal_full_folds(spark):
    sizes = {"a": [1, 1, 1, 6], "b": [0, 5, 0, 16], "c": [8, 8, 1, 0], "d": [37, 0, 91, 3], "e": [0, 0, 0, 64]}
    state = RO.no_roots(spark)
    so_far = []
    for batch in range(4):
        new = [(w, p + 1, sha((w, batch, p))) for w, s in sizes.items() for p in range(s[batch])]
        n = {w: sum(s[:batch]) for w, s in sizes.items()}
        so_far += [(w, n[w] + p, h) for w, p, h in new]
        leaves = spark.createDataFrame(new, "workspace STRING, position BIGINT, evidence_hash STRING")
        state = durable(RO.append_leaves(state, leaves, fan=2))
        want = FN.merkle_roots(spark.createDataFrame(so_far, "workspace STRING, position BIGINT, evidence_hash STRING"))
        assert dict(RO.state_roots(state).collect()) == dict(want.collect())
    assert {r.workspace: r.n for r in state.collect()} == {w: sum(s) for w, s in sizes.items()}
    assert all([p.level for p in r.peaks] == [b for b in range(20) if r.n >> b & 1] for r in state.collect())
    same = RO.append_leaves(state, leaves.limit(0))
    assert dict(RO.state_roots(same).collect()) == dict(want.collect())
    assert RO.append_leaves(RO.no_roots(spark), leaves.limit(0)).count() == 0


def test_an_append_writes_its_rows_down_once_before_the_ledger(spark, tmp_path, monkeypatch):
    from auditlake.operators import finalize as FN
    from auditlake.sources import ledger as LS

    cuts, real = [], FN.durable

    def counted(df):
        cuts.append(df.columns)
        return real(df)

    for module in (FN, LS):
        monkeypatch.setattr(module, "durable", counted)
    rows = spark.range(500).selectExpr("sha2(cast(id % 90 AS string), 256) AS merkle_root", "sha2('k', 256) AS public_key_hex",
                                       "timestamp_seconds(id % 7) AS created_at").repartition(5)
    path = str(tmp_path / "ledger")
    assert LS.append_ledger(spark, rows, path) == (1, 500) and LS.append_ledger(spark, rows, path) == (501, 1000)
    assert len(cuts) == 2  # three an append before
    assert sorted(r.id for r in LS.read_ledger(spark, path).select("id").collect()) == list(range(1, 1001))
