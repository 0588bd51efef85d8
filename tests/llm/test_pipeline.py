"""The pipeline on a small corpus: every stage's decision takes effect, and clean documents stay."""

import random

import corpus_pipeline

from glosswright.llm import decontaminate, mixing, secrets, similar, toxicity


def test_run(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    passage, copied = prose(12), prose(40)
    texts = {0: copied, 1: copied, 2: f"{copied} end", 3: f"{prose(20)} {passage} {prose(20)}", 4: f"{prose(20)} token=abcdefgh123 {prose(5)}", 5: None, 6: ""}
    texts |= {i: prose(30) for i in range(7, 30)}
    texts |= {i: f"{prose(10)} vile nasty {prose(10)} foul vile nasty" for i in range(30, 60)}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save(rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save([(1, passage)], "item_id long, text string", "benchmark")
    save([(i, 0, int(i >= 30)) for i in texts if i not in (5, 6)], "doc_id long, quality int, toxic int", "labels")
    mix = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {x.doc_id: x for x in mix}
    assert len(mix) > len(kept) and len({(x.doc_id, x.copy) for x in mix}) == len(mix)
    clean = {0, *range(4, 30)}
    assert set(kept) <= clean and {5, 6} <= set(kept)
    assert all(x["taken"] > 0 for d, x in kept.items() if d not in (5, 6))
    assert 4 not in kept or "[assign]" in kept[4].text
    docs = {x.doc_id: x for x in rows_before_mixing(spark, str(tmp_path))}
    assert set(docs) == clean and "token=abcdefgh123" not in docs[4].text
    goal = {x.source: x.target for x in kept.values()}
    for source, target in goal.items():
        assert abs(sum(x["taken"] for x in mix if x.source == source) - target) <= 1


def rows_before_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    return docs.collect()


def test_stages_keep_rows_and_columns(spark):
    """Rows without an id or of one id are judged each; columns of any name pass through every stage; a very long text does too."""
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    passage, copied, long, block = prose(12), prose(40), prose(60_000), "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nMIIE+/a=\nq0\n-----END RSA PRIVATE KEY-----"
    texts = [(None, f"{prose(9)} {passage} {prose(9)}"), (None, clean := prose(30)), (7, f"{passage} x"), (7, other := prose(31)), (8, None), (8, ""), (9, long), (10, f"a {block} b"), (11, copied), (11, copied), (None, copied)]
    texts += [(100 + i, prose(20)) for i in range(60)] + [(200 + i, f"{prose(9)} vile nasty {prose(9)} foul vile nasty") for i in range(60)] + [(None, f"{prose(9)} vile nasty {prose(9)} foul vile nasty")]
    names = "doc_id text source n_chars a.b row hash bad_digest x`y one copy_".split()
    schema = ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, ["long", "string", "string", "long"] + ["string"] * 7))
    docs = spark.createDataFrame([(d, t, "s", len(t or ""), *"abcdefg") for d, t in texts], schema)
    labels = spark.createDataFrame([(d, int("vile" in t)) for d, t in texts if d and t and d >= 100], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string")
    stages = {
        "toxic": lambda df: toxicity.without_toxic(df, labels),
        "near": similar.deduplicated,
        "bench": lambda df: decontaminate.decontaminated(df, bench),
        "secret": secrets.redacted,
        "mix": mixing.mixed,
    }
    left = {k: stage(docs) for k, stage in stages.items()}
    for k, out in left.items():
        assert out.columns[: len(names)] == names
        rows = out.collect()
        assert all(tuple(r)[4 : len(names)] == tuple("abcdefg") for r in rows)
        assert long in {r.text for r in rows} or k == "mix"
        assert stages[k](docs.limit(0)).collect() == []
    texts_of = {k: [r.text for r in out.collect()] for k, out in left.items()}
    assert {clean, other, long, copied, f"{passage} x", None, ""} <= set(texts_of["toxic"]) and not any("vile" in (t or "") for t in texts_of["toxic"])
    assert {clean, other, long, copied, None, ""} <= set(texts_of["bench"]) and not any(passage in (t or "") for t in texts_of["bench"])
    assert texts_of["near"].count(copied) == 1 and texts_of["toxic"].count(copied) == 3
    assert "a [pem] b" in texts_of["secret"] and not any("MIIE" in (t or "") for t in texts_of["secret"])
