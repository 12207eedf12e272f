"""Null, truncated and empty media; ledgers past a million versions and with two writers."""

import json

import pytest
from pyspark.sql import functions as F

from strandloom.llm import jpeg_media, token_counts


def test_damaged_media_give_a_reason_and_spare_the_others(spark):
    good = jpeg_media.encode(b"some payload".ljust(64, b"\0"))
    long = jpeg_media.encode(bytes(range(256)) * 20)
    bad = {2: None, 3: b"", 4: good[: len(good) // 2], 5: good[:3], 6: b"no image at all", 7: long[:-200], 8: good.replace(b"\xff\xc0", b"\xff\xc2"), 9: good[:40], 10: bytes(100), 12: good[:-2].replace(b"\xff\xc4", b"\xff\xfe")}
    rows = [(1, 12, good)] + [(k, 1, v) for k, v in bad.items()] + [(11, 5120, long)]
    df = spark.createDataFrame([(i, n, None if m is None else bytearray(m), "x") for i, n, m in rows], "doc_id long, n_bytes long, media binary, feature string").coalesce(1)
    got = {r.doc_id: r for r in jpeg_media.media_features(df).collect()}
    assert len(got) == len(rows)
    for k in (1, 11):
        alone = jpeg_media.media_features(df.where(F.col("doc_id") == k)).first()
        assert got[k] == alone and alone.problem is None and alone.payload_bytes in (64, 5120)
    for k, v in bad.items():
        assert got[k].problem and got[k].feature is None and got[k].payload_sha256 is None and got[k].media_bytes == (None if v is None else len(v)), k
    assert got[2].problem == "no media" and got[3].problem == "empty" and got[4].problem.startswith("damaged")


def events(spark, n):
    return spark.createDataFrame([("s", "en", "v", 1, n)], token_counts.EVENTS)


def test_ledger_past_a_million_versions(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "l"))
    assert ledger.commit("first", events(spark, 5))
    done = json.loads((tmp_path / "l/commits/000000.json").read_text())
    (tmp_path / "l/commits/999999.json").write_text(json.dumps(done | {"version": 999999}))
    (tmp_path / "l/last").unlink()
    for k in range(3):
        assert token_counts.Ledger(spark, str(tmp_path / "l")).commit(f"b{k}", events(spark, 10))
        assert not ledger.commit(f"b{k}", events(spark, 10))
    assert [r.n_tokens for r in ledger.totals().collect()] == [35]
    assert ledger._versions()[-1] == 1000002 and ledger.batches()[-1] == "b2"
    # a pointer that lags, is damaged, or points nowhere
    for text in (json.dumps({"version": 999999}), '{"vers', json.dumps({"version": 5})):
        (tmp_path / "l/last").write_text(text)
        (tmp_path / "l/.last.crc").unlink(missing_ok=True)
        assert ledger._last()["version"] == 1000002


def test_two_writers_between_check_and_rename(spark, tmp_path, monkeypatch):
    """Both have read the same last commit and written their totals; the second rename fails and nothing of it counts."""
    one, two = (token_counts.Ledger(spark, str(tmp_path / "l")) for _ in range(2))
    assert one.commit("base", events(spark, 1))
    put, inner = token_counts.Ledger._put, []

    def slow(self, path, content):
        if self is one and "/commits/" in path and not inner:
            inner.append(True)
            assert two.commit("other", events(spark, 100))
        return put(self, path, content)

    monkeypatch.setattr(token_counts.Ledger, "_put", slow)
    with pytest.raises(RuntimeError, match="another writer"):
        one.commit("mine", events(spark, 10))
    assert [r.n_tokens for r in one.totals().collect()] == [101]
    assert one.commit("mine", events(spark, 10)) and [r.n_tokens for r in two.totals().collect()] == [111]
