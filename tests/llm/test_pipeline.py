"""Each stage of the pipeline takes effect, keeps its columns, and is checked against plain code."""

import random
import re

import corpus_pipeline
from lumenflow.llm import mixing


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        frames.append(docs)
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    first, near, clean, masked = ({r["doc_id"]: r for r in f.collect()} for f in frames[:4])
    mix = {}
    for r in frames[4].collect():
        mix.setdefault(r["doc_id"], []).append(r)
    assert 0.97 * spark.read.parquet(f"{sf}/documents.parquet").count() <= len(first)
    assert set(mix) <= set(masked) == set(clean) < set(near) < set(first)
    # no two of those kept are linked
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, r in near.items() if len(w := r["text"].lower().split()) >= 5}
    ids = sorted(sets, key=lambda i: len(sets[i]))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[b]) * 0.8 > len(sets[a]):
                break
            assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall(r["text"].lower())
        wins |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))} if w else set()
    size = {len(g) for g in wins}
    hit = {i: any(tuple(w[j : j + k]) in wins for k in size for j in range(len(w) - k + 1)) for i, r in near.items() for w in [word.findall(r["text"].lower())]}
    assert {i for i, h in hit.items() if not h} == set(clean)
    secret = re.compile(r"[0-9a-f]{32,}")
    assert any(secret.search(r["text"]) for r in clean.values()) and not any(secret.search(r["text"]) for r in masked.values())
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())
    space = re.compile(r"[^\x20\x09-\x0D]+")
    for i, rows in mix.items():
        w = space.findall(masked[i]["text"])
        assert 0 < sum(r["n_words"] for r in rows) <= 2 * len(w)
        assert all(space.findall(r["text"]) == w[256 * r["block"] : 256 * r["block"] + 256] for r in rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(frames[3]).collect()}
    assert {i: n for i, n in taken.items() if n} == {i: sum(r["n_words"] for r in rows) for i, rows in mix.items()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, _h int, `_hash` string, `_id` int, spans string, `_language` string, `a.b` array<int>, row_ struct<`x.y`:int>"


def test_repeated_rows_nulls_and_odd_columns(spark, sf, tmp_path):
    """Rows that share an id go or stay each by itself; no name of a column clashes; nulls are kept or go as stated."""
    rng = random.Random(3)
    base = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) between 400 and 4000").limit(300).collect()
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    texts = [r["text"] for r in base]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in base]
    near = texts[0] + " end"
    tail = lambda n: (n, "h", n, "s", "l", [n], (n,))
    rows += [(base[5]["doc_id"], near, "en", None), (None, texts[1] + " end", "en", "a"), (None, " ".join(texts[7].split()[::-1]), "en", "a")]
    rows += [rows[3], (base[9]["doc_id"], item + " " + " ".join(texts[8].split()[::-1]), "en", "b"), (1, None, None, None), (2, "", "en", "a")]
    rows += [(-3, " ".join("".join(rng.choice("qxzjkwvy") for _ in range(9)) for _ in range(60)), None, "a")]
    d = spark.createDataFrame([(*r, None, *tail(n)) for n, r in enumerate(rows)], ODD).repartition(4)
    out = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        d = stage(spark, d, sf)
        assert d.columns == spark.createDataFrame([], ODD).columns
        d.write.parquet(f"{tmp_path}/{len(out)}")
        d = spark.read.parquet(f"{tmp_path}/{len(out)}")
        out.append([(r["doc_id"], r["text"]) for r in d.collect()])
    first, second, third, _ = out
    want = [r[:2] for r in rows if r[1] and r[0] != -3]
    assert set(first) == set(want) and len(first) == len(want), (set(want) ^ set(first))
    # the near copy that shares an id goes, the other text of that id stays; a null id is a document like others
    assert (base[5]["doc_id"], texts[5]) in second and (base[5]["doc_id"], near) not in second and (None, texts[1] + " end") not in second
    assert (None, rows[len(base) + 2][1]) in second and second.count(rows[3][:2]) == 1
    assert len(second) == len(set(second)) and (base[9]["doc_id"], texts[9]) in third and not any(t.startswith(item) for _, t in third)
    corpus_pipeline.mix_sources(spark, d, sf).count()


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_corpus_without_labels_stays(spark, sf):
    """No language can be learned, so that none is missing; the stage gives the documents back."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.keep_language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count()
