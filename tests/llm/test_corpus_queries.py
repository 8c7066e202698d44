"""The registered corpus queries: brute force and accuracy where there is no SQL, and the pipeline stage by stage."""

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sigspark.llm import decontaminate, queries
from sigspark.session import table


def test_neighbours_recall(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in rows}
    ids, unit = np.array(sorted(v)), np.array([v[i] / np.linalg.norm(v[i]) for i in sorted(v)])
    got = queries.op1_pruned_graph(spark, sf).collect()
    hit = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        score = unit @ unit[ids == q][0]
        want = sorted((i for i in ids if i != q), key=lambda i: (-score[ids == i][0], i))[:5]
        hit += len({r.vec_id for r in got if r.query_id == q} & set(want))
        total += 5
    assert hit / total >= 0.9 and len(got) == total


def test_mix_covers_all_documents_by_weights(spark, sf):
    got = queries.op2_temperature_mix(spark, sf).toPandas()
    assert set(got.doc_id) == {r.doc_id for r in table(spark, sf, "documents").select("doc_id").collect()}
    once = got[got.epoch == 0].groupby("source").tokens.sum()
    every = got.groupby("source").tokens.sum()
    # the last document of a source may pass its quota
    assert (every <= 1.5 * once + got.tokens.max() + 1).all() and (every / once).min() == 1.0 and (every / once).max() >= 1.49
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("block"))


def test_shards_follow_the_law(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = queries.op3_external_shuffle(spark, sf).collect()
    assert len(got) == len(docs) and {r.law for r in got} == {"key"}
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_toxicity_and_language_on_held_out_rows(spark, sf):
    marks = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = [r for r in queries.op6_clause_grammar(spark, sf).collect() if r.held_out and r.doc_id in marks]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == marks[r.doc_id] for r in got]) >= 0.85
    langs = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    told = queries.op10_compression_langid(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in told)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in told if r.held_out]) >= 0.9


def test_tokens_equal_whole_encoding(spark, sf):
    from tokenizers import Tokenizer

    tool, start = Tokenizer.from_file(queries.TOKENIZER), 0
    got = {r.doc_id: tuple(r) for r in queries.op7_token_records(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    for r in table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = np.array([*tool.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        assert got[r.doc_id] == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_line_templates_keep_the_other_lines(spark, sf):
    lines = {r.doc_id: len(r.text.split("\n")) for r in table(spark, sf, "documents").collect()}
    got = queries.op8_line_templates(spark, sf).collect()
    assert len(got) == len(lines) and all(r.n_lines == lines[r.doc_id] and 0 <= r.n_dropped <= r.n_lines for r in got)


def test_pipeline_stage_by_stage(spark, sf):
    from test_corpus_operators import brute_components

    docs = table(spark, sf, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token records"]
    known = steps["language ID"](spark, docs, sf).cache()
    assert known.columns == docs.columns and docs.count() * 0.95 <= known.count() <= docs.count()
    one = steps["n-gram Jaccard join"](spark, known, sf).cache()
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute_components(rows)})
    clean = steps["benchmark decontamination"](spark, one, sf).cache()
    leaks = {r.doc_id for r in decontaminate.report(one, table(spark, sf, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaks
    mixed = steps["mixing sources"](spark, clean, sf).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    out = steps["token records"](spark, mixed, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(tuple(r) for r in out)


def brute_drops(docs, min_texts=10, min_constant=0.6, min_tokens=4, literal_tokens=1, long_tokens=50, long_texts=3):
    """The literal lines to drop, by the three laws of the operator."""
    texts, mask = {}, lambda w: tuple("<*>" if re.search(r"[0-9@]|://", x) else x for x in w)
    for _, text in docs:
        for line in (text or "").split("\n"):
            if w := tuple(re.findall(r"[^\s]+", line, re.ASCII)):
                texts.setdefault(w, set()).add(text)
    drop = {w for w, t in texts.items() if len(t) >= min_texts and len(w) >= literal_tokens or len(t) >= min(long_texts, min_texts) and len(w) >= long_tokens}
    places, made = {}, {}
    for w, t in texts.items():
        for pos, x in enumerate(mask(w)):
            places.setdefault((len(w), mask(w)[:3], pos, x), set()).update(t)
    shape = {w: tuple(x if x != "<*>" and len(places[len(w), mask(w)[:3], pos, x]) >= min_texts else None for pos, x in enumerate(mask(w))) for w in texts if len(w) >= min_tokens}
    for w, s in shape.items():
        made.setdefault((mask(w)[:3], s), set()).update(texts[w])
    return drop | {w for w, s in shape.items() if sum(x is not None for x in s) >= min_constant * len(s) and len(made[mask(w)[:3], s]) >= min_texts}


def test_line_templates_equal_brute_force(spark, sf, tmp_path):
    with_short = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nLes."))).otherwise(F.col("text"))
    table(spark, sf, "documents").select("doc_id", with_short.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table(spark, str(tmp_path), "documents").collect()]
    drop, got = brute_drops(docs), {r.doc_id: r for r in queries.op8_line_templates(spark, str(tmp_path)).collect()}
    assert ("Les.",) in drop
    for doc_id, text in docs:
        kept = [x for x in text.split("\n") if tuple(re.findall(r"[^\s]+", x, re.ASCII)) not in drop]
        assert (got[doc_id].n_dropped, got[doc_id].kept_md5) == (len(text.split("\n")) - len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest())


CLASHES = "lang_pred score rejected tokens epoch block order_in_block lang_pred_in _th _bad_id _kept _node _source source_tokens quota epochs _h _range _base _before _at".split()


def test_stages_keep_extra_and_clashing_columns(spark, sf):
    docs = table(spark, sf, "documents").limit(60)
    docs = docs.select("*", F.array("lang").alias("extra"), *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in CLASHES))
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, sf)
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString(), name
        rows = got.collect()
        assert len(rows) > 30 and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHES) and all(r.extra == [r.lang] for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 60
