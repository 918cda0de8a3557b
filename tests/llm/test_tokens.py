import glob
import hashlib

import numpy as np
import pytest

from caresift.llm import tokens


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 65, 1_000, 70_000])
def test_permutation(total):
    out = tokens.permuted(np.arange(total), total, 99)
    assert sorted(out.tolist()) == list(range(total))
    assert total < 60 or (out != tokens.permuted(np.arange(total), total, 98)).any()
    assert total < 60 or np.abs(np.corrcoef(out, np.arange(total))[0, 1]) < 0.5


def test_round_trip_of_shards(spark, tmp_path):
    texts = [None, "", "Ein kleiner Text.", "é😀\n" * 70, "word " * 900, "same", "same"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (5, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3)
    shards = tokens.write_shards(df, folder=str(tmp_path / "a"), length=16, per_shard=10)
    own = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    files = {int(f.split("shard=")[1].split("/")[0]): open(f, "rb").read() for f in glob.glob(f"{tmp_path}/a/shard=*/part-*")}
    assert sorted(files) == list(range(-(-shards.sequences // 10)))
    stored = b"".join(files[k][:-1] for k in sorted(files))
    assert all(f.endswith(b"\n") for f in files.values()) and len(stored) == 32 * shards.sequences
    assert all(len(files[k]) == 321 for k in sorted(files)[:-1])

    index = shards.index.collect()
    assert sorted(r.slot for r in index) == list(range(shards.sequences))
    parts = {}
    for r in index:
        ids = np.frombuffer(stored[32 * r.slot:32 * r.slot + 32], "<u2")
        assert (r.shard, r.record) == divmod(r.slot, 10)
        for d in r.docs:
            parts.setdefault(d.doc_id, []).append((d["from"], ids[d["at"]:d["at"] + d.n].tolist()))
    for i, text, _ in rows:
        want = own.encode_ordinary(text or "") + [tokens.END]
        got = sorted(parts[i])
        if i == 5:
            assert all(p == want[k:k + len(p)] for k, p in got) and sum(len(p) for _, p in got) == 2 * len(want)
        else:
            assert [x for _, p in got for x in p] == want

    table = tokens.sequence_table(spark, shards).collect()
    assert {r.slot: r.ids_sha256 for r in table} == {k: hashlib.sha256(stored[32 * k:32 * k + 32]).hexdigest() for k in range(shards.sequences)}
    assert sum(r.n_tokens for r in table) == sum(len(own.encode_ordinary(t or "")) + 1 for _, t, _ in rows)


def test_empty_table(spark):
    shards = tokens.write_shards(spark.createDataFrame([], "doc_id long, text string"))
    assert shards.sequences == 0 and tokens.sequence_table(spark, shards).count() == 0
