import random

import __spark_entry__ as entry
import corpus_pipeline as P
from test_models import labelled


def write(df, where, name):
    df.write.parquet(f"{where}/{name}.parquet")


def test_stages_against_planted_cases(spark, tmp_path):
    rnd = random.Random(8)
    rows, labels = labelled(5, 240)
    clean = [(i, t) for i, t in rows if i % 4]
    passage = " ".join(f"shared{k}" for k in range(70))
    extra = [(1000, clean[0][1]), (1001, clean[0][1])]
    for k, (_, t) in enumerate(clean[1:6]):
        w = t.split()
        w[rnd.randrange(len(w))] = "edited"
        extra.append((1100 + k, " ".join(w)))
    own = lambda k: " ".join(f"own{k}w{i}" for i in range(150))
    extra += [(1200 + k, f"{own(k)} {passage} {own(k + 50)}") for k in range(4)] + [(1300, None), (1301, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
    write(docs, tmp_path, "documents")
    write(spark.createDataFrame(labels, "doc_id long, toxic int"), tmp_path, "labels")
    seen, df = {}, docs
    for name, stage in P.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in df.collect()}
        if name != P.STAGES[-1][0]:
            assert df.columns == docs.columns
    ids = {k: set(v) for k, v in seen.items()}
    toxic = {i for i, t in labels if t}
    assert len(toxic - ids["toxicity"]) == len(toxic) - len(toxic & ids["toxicity"]) and len(toxic & ids["toxicity"]) <= 0.05 * len(toxic)
    assert {i for i, _ in clean} | {i for i, _ in extra} <= ids["toxicity"]
    assert ids["toxicity"] - ids["exact dedup"] == {1000, 1001}
    assert {1100 + k for k in range(5)} <= ids["exact dedup"] - ids["MinHash near-dedup"]
    assert {i for i, _ in clean} <= ids["MinHash near-dedup"]
    cut = seen["suffix-array dedup"]
    assert [passage in cut[1200 + k].text for k in range(4)] == [True, False, False, False]
    assert cut[1201].n_chars == len(cut[1201].text) and cut[1201].text.startswith("own1w0")
    assert all(cut[i].text == t for i, t in clean)
    assert ids["best-fit packing"] == ids["suffix-array dedup"]
    whole = entry.queries()["pipeline"](spark, str(tmp_path)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.piece, r.tokens) for r in rs)
    assert key(whole) == key(df.collect())
