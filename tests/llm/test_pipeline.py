import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from test_mixing import taken
from test_quality import brute as base_counts
from test_simhash import fingerprint, groups

from digestry.llm import packing, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    pick = random.Random(12)
    lexicon = ["".join(pick.choice(["ka", "lo", "mi", "ten", "ur", "sa"]) for _ in range(pick.randint(1, 4))) for _ in range(700)]
    rows = []
    for i in range(160):
        text = " ".join(pick.choice(lexicon) for _ in range(pick.choice([3, 20, 60, 300, 1500])))
        if i % 9 == 0:
            text += " password = abcdef123456 and on"
        if i % 11 == 0:
            text = "stuck " * 400
        if i % 6 == 5:
            text = rows[-1][1]
        rows.append((i, text, "en", pick.choice(["a", "a", "a", "b", None]), len(text)))
    return rows + [(500, None, None, None, None), (501, "", "en", "a", 0)]


def test_stages_and_run_against_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    judge = quality._judge()
    kept = [r for r in rows if judge(r[1])[6]]
    assert all(not base_counts(r[1])[5] for r in kept)
    prints = {r[0]: fingerprint(r[1]) for r in kept}
    reach = groups(set(prints.values()))
    kept = [r for r in kept if r[0] == min(q[0] for q in kept if prints[q[0]] in reach[prints[r[0]]])]
    scan = secrets.make_scanner()
    masked = [(r[0], m := secrets.mask(r[1], scan(r[1])), r[2], r[3], len(m)) for r in kept]
    assert any(secrets.MASK in r[1] for r in masked)
    mix = {r["doc_id"]: r["taken"] // r["size"] for r in taken(spark, masked).collect()}
    encode, want = packing.make_encoder(packing.default_vocabulary()), Counter()
    for r in masked:
        ids = [*encode(r[1]), packing.END_ID]
        for k, (start, n) in enumerate(packing.cut(len(ids))):
            want[r[0], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += mix[r[0]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame(documents()[:20], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
