"""Each corpus operator on small tables: brute force, round trips, and the cases of its docstring."""

import hashlib
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.llm import decontaminate, graphindex, langid, linetemplates, mixing, paritysketch, shards, shingles, tokenfile, toxicgrammar, urltrie
from sigspark.llm.common import WORKER_HELD, new_folder, set_aside

LONG = "word " * 30_000
TEXTS = ["one two three four five six", None, "", " \n\t", "one two three four five six", "One TWO three four five six", "é Ñandú ß", LONG, "x", "!!! ..."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, block string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, nulls in every column, empty and very long texts, copies, clashing extra columns."""
    rows = [(i, t, "en", "s", 1, "a", "b", "c") for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, "one two three four five six", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "other text under a used id", "de", "t", 2, "a", "b", "c")]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_clashing_names_are_set_aside(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Shard int, shard_in int, x int")
    assert set_aside(df, ["shard"]).columns == ["Shard_in_in", "shard_in", "x"]


# nearest neighbours


def brute_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        unit = {i: np.array(v, float) for i, v in vectors.items() if i != q}
        a = np.array(vectors[q], float)
        score = {i: float(v @ a / np.sqrt(v @ v) / np.sqrt(a @ a)) for i, v in unit.items()}
        out[q] = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
    return out


def test_graph_recall_over_shards(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    v = {i: (centres[i % 20] + rng.normal(size=16)).tolist() for i in range(2_000)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = graphindex.nearest(df, F.col("vec_id") % 50 == 0, 5, shard_nodes=700).collect()
    want = brute_nearest(v, range(0, 2_000, 50), 5)
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    assert all(len(x) == 5 for x in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / 200 >= 0.95


def test_graph_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (50, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in graphindex.nearest(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 50, -1.0), (50, 1, 3, 0.0), (50, 2, 0, -1.0), (50, 3, 1, -1.0), (50, 4, 2, -1.0)]
    assert graphindex.nearest(df.limit(0), F.lit(True)).count() == 0


def test_graph_with_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 1.0, 1.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(600)]
    got = graphindex.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5)
    assert [r.vec_id for r in got.where("query_id = 150").orderBy("rank").collect()] == [0, 3, 6, 9, 12]


def test_graph_answers_the_same_in_bounded_blocks_of_queries(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(900)], "vec_id long, embedding array<double>")
    ask = lambda n: rows_of(graphindex.nearest(df, F.col("vec_id") % 3 == 0, 5, shard_nodes=400, block_queries=n), "query_id", "rank", "vec_id", "score")
    assert len(ask(1_000)) == 1_500 and ask(50) == ask(1_000)
    queries = df.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    sizes = [r["count"] for r in graphindex.blocks(queries, 300, 3, 50).groupBy("shard", "block").count().collect()]
    assert len(sizes) == 18 and max(sizes) <= 80


# mixing


def test_mixture_meets_limit_and_keeps_all(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 3 else f"s{i % 4}") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, repetition=1.5, block_tokens=500).toPandas()
    tokens = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    share = np.array([tokens[s] for s in sorted(tokens)]) / sum(tokens.values())
    ratio = {s: got[got.source == s].tokens.sum() / tokens[s] for s in tokens}
    assert set(got.doc_id) == set(range(3_000))
    assert max(ratio.values()) == pytest.approx(1.5, abs=0.02) and min(ratio.values()) == pytest.approx(1.0, abs=0.001)
    a = mixing.exponent(mixing.totals_of(share), None, 1.5)
    want = share**a / (share**a).sum()
    blocks = got.groupby(["block", "source"]).tokens.sum().unstack().fillna(0)
    inner = blocks.iloc[1:-1]
    assert np.abs(inner[sorted(tokens)].to_numpy() / inner.sum(axis=1).to_numpy()[:, None] - want).max() < 0.08
    epochs = got.groupby("doc_id").epoch.apply(sorted)
    assert all(e == list(range(len(e))) for e in epochs)


def test_mixture_reaches_a_target_entropy_by_either_way_of_summing(spark):
    share = np.array([0.6, 0.3, 0.1])
    by_job = mixing.totals_by_job(spark.createDataFrame([(float(s),) for s in share], "share double"))
    for totals in (mixing.totals_of(share), by_job):
        a = mixing.exponent(totals, 1.0, None)
        w = share**a / (share**a).sum()
        assert -(w * np.log(w)).sum() == pytest.approx(1.0, abs=1e-6)
        assert mixing.exponent(totals, 9.0, None) == 0.0


def test_mixture_with_a_budget_takes_no_more(spark):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i < 90 else "y") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.mix(docs, entropy=0.6, repetition=None, budget=100).toPandas()
    assert 100 <= got.tokens.sum() < 108


def test_mixture_cases(odd):
    got = mixing.mix(odd, repetition=2.0)
    assert set(odd.columns) - {"block"} <= set(got.columns) and "block_in" in got.columns
    assert got.where("epoch = 0").count() == odd.count()
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.where("text = ''")).count() == 1


# external shuffle


def shard_rows(spark, df, **kw):
    folder = new_folder(spark, "shards")
    return shards.read(spark, folder, shards.write(df, folder, **kw))


def test_shards_hold_everything_in_gapless_slots(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3_000)], "doc_id long, text string")
    got = shard_rows(spark, docs, bucket_bytes=2_000).toPandas()
    assert sorted(got.doc_id) == list(range(3_000))
    for _, some in got.groupby("shard"):
        assert sorted(some.slot) == list(range(len(some))) and 250 < len(some) < 500
    assert got.sort_values(["shard", "slot"]).doc_id.diff().abs().median() > 100
    again = shard_rows(spark, docs, bucket_bytes=2_000).toPandas()
    assert got.sort_values("doc_id")[["shard", "slot"]].to_numpy().tolist() == again.sort_values("doc_id")[["shard", "slot"]].to_numpy().tolist()


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(5_000).select(shards.shard_of(F.col("id"), 8, 17).alias("a"), shards.shard_of(F.col("id"), 9, 17).alias("b"))
    assert ids.where("a != b AND b != 8").count() == 0 and 400 < ids.where("b = 8").count() < 720


def test_fisher_yates_is_a_uniform_permutation():
    seen = [tuple(shards.fisher_yates(3, s)) for s in range(3_000)]
    assert all(abs(seen.count(p) - 500) < 120 for p in set(seen)) and len(set(seen)) == 6
    assert shards.fisher_yates(0, 1).tolist() == [] and shards.fisher_yates(1, 1).tolist() == [0]


def test_shard_cases(spark, odd, monkeypatch):
    got = shard_rows(spark, odd)
    assert got.count() == odd.count() and "shard_in" in got.columns
    assert got.where("doc_id IS NULL").select("shard").distinct().count() == 1
    assert shard_rows(spark, odd.limit(0)).count() == 0
    monkeypatch.setattr(shards, "REPEATED_ROWS", 100)
    same = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    out = shard_rows(spark, same, bucket_bytes=50).toPandas()
    assert out.shard.nunique() == 1 and sorted(out.slot) == list(range(500))


# url rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/x", "block"), ("", "/bad", "block"), ("org", "/fr/", "block")]


def brute_rule(host, path):
    fits = [r for r in RULES if host and (not r[0] or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0].split(".")) if r[0] else 0, len(r[1]), r[2]), default=None)


URLS = ["http://a.net/", "http://net/", "http://net", "https://WWW.Example.NET/en/1?x=1", "http://example.net/en", "http://x.example.com/de/#t", "http://b.org/fr/", "http://a.org/xyz", "http://q.a.org/fr/", "http://z/bad/1", "no scheme", "", None, "a://b://c/d", "://net/", "http://net?x", "http://example.neten/en/", "http://É.net/en/", "http://x..net//en/"]


@pytest.mark.parametrize("most", [10, 2])
def test_longest_rule_wins_in_the_trie_and_in_the_join(spark, most):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = urltrie.judge(pages, RULES, max_broadcast=most).collect()
    assert len(got) == len(URLS)
    for r in got:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url or "")
        host = m[1].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) if m else ""
        path = m[2] if m else ""
        want = brute_rule(host, path)
        assert (r.host, r.path, r["rule"], r.verdict) == (host, path, want and want[0] + want[1], want[2] if want else "allow"), r
    assert {"host_in", "rule_in"} <= set(got[0].asDict())
    assert urltrie.judge(pages.limit(0), RULES).count() == 0


# decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def brute_report(docs, items):
    wins = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc_id, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "B C d e f g h i j k"), (10, "short ñ item"), (10, "again"), (3, ""), (4, None), (5, "one two three four five six"), (None, "x"), (2, "again"), (6, "w " * 12)]


@pytest.mark.parametrize("most", [1_000, 0])
def test_report_equals_brute_force(spark, odd, most):
    more = [(100, "zero A b, c d e f g h i j k l end"), (101, "short Ñ item. short ñ item"), (102, "again! again b c d e f g h i j k"), (103, "w " * 40)]
    docs = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*m, "en") for m in more], "doc_id long, text string, lang string"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.report(docs, bench, max_broadcast=most)
    assert rows_of(got, *got.columns) == brute_report([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    none = decontaminate.report(docs, bench.limit(0))
    assert none.count() == docs.count() and none.where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_clean_drops_documents_or_spans(spark):
    docs = spark.createDataFrame([(1, "keep me"), (2, "before, a b c d e f g h i j k l; after."), (3, None), (2, "same id, clean"), (None, "x again")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS[:4], "item_id long, text string")
    assert rows_of(decontaminate.clean(docs, bench), "doc_id", "text") == sorted([(1, "keep me"), (3, None), (2, "same id, clean")], key=repr)
    spans = rows_of(decontaminate.clean(docs, bench, drop="spans"), "doc_id", "text")
    assert spans == sorted([(1, "keep me"), (2, "before; after."), (3, None), (2, "same id, clean"), (None, "x")], key=repr)


# toxicity


def test_grammar_reads_clauses():
    g = toxicgrammar.Grammar({"idiot": 5.0, "lowei*": 4.0}, (1.0,) * 16, -3.0)
    r = toxicgrammar.Reader(g)
    at = lambda text: np.flatnonzero(r.readings(text)[0]).tolist()
    assert at("an idiot") == [0] and at("you idiot") == [4] and at("she said he is an idiot") == [5]
    assert at("you are not an idiot") == [6] and at("not so bad and yet what an idiot") == [0]
    assert at("I will kill you") == [12] and at("you. an idiot") == [0] and at('the "idiot" word') == [1]
    assert at("loweixyz") == [0] and at("lowei") == [] and r.readings(None)[1] == 0
    assert r.score(r.readings("you idiot")[0]) > 0.7 > r.score(r.readings("")[0])


def test_toxicity_is_learned_and_cases(spark, odd):
    rng = np.random.default_rng(0)
    vocabulary = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    say = lambda: " ".join(rng.choice(vocabulary, 30))
    rows, marks = [], []
    for i in range(900):
        bad = i % 3 == 0
        rows.append((i, say() + (f". you vexo{rng.choice(vocabulary)} here. " if bad else ". ") + say()))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    grammar = toxicgrammar.train(docs, labels.where("doc_id % 2 = 0"))
    got = toxicgrammar.judge(docs.join(labels, "doc_id"), grammar).where("doc_id % 2 = 1")
    assert got.where("predicted = toxic").count() / got.count() > 0.97
    out = toxicgrammar.judge(odd, grammar)
    assert out.count() == odd.count() and "score_in" in out.columns and out.where("score IS NULL OR predicted = 1").count() == 0
    assert toxicgrammar.judge(odd.limit(0), grammar).count() == 0
    bare = toxicgrammar.train(docs, labels.limit(0))
    assert toxicgrammar.judge(docs, bare).select("score").distinct().count() == 1


# token records

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_records_round_trip(spark, odd, name):
    from tokenizers import Tokenizer

    file = public_tokenizers.path(name)
    folder = new_folder(spark, "tokens")
    tokenfile.write(odd, file, folder, n_files=3)
    got = tokenfile.read(spark, folder).orderBy("start").collect()
    tool = Tokenizer.from_file(file)
    want = []
    for r in odd.collect():
        ids = np.array([*tool.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_words_encode_like_whole_texts(spark, sf):
    model = open(TOKENIZER, encoding="utf-8").read()
    odd_ones = ["", "a.b", "<|endoftext|>", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ Σ.", "é caf́e.", "it's don't.", "\x1c a\x1cb\t\r\x0bq\xa0z", "ß,", "ﬁ.", "１２３", "힣 한국어.", "Ǆ.", "x" * 3_000, "(the) 'tis. !?", "a-b --c- d_"]
    texts = odd_ones + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert tokenfile.splits_words(model)
    assert tokenfile.WordEncoder(model, "<u2").encode(texts) == tokenfile.WholeEncoder(model, "<u2").encode(texts)


def test_words_that_differ_by_case_or_marks_are_encoded_once():
    model = open(TOKENIZER, encoding="utf-8").read()
    encoder, asked = tokenfile.WordEncoder(model, "<u2"), []

    class Listening:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split(" "))
            return self.tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer = Listening(encoder.tokenizer)
    texts = ["ciudád Ciudád CIUDÁD ciudád$$$ ciudád&&& ciudád.%%%", "", "ŝtono $$$ Ŝtono&&&"]
    whole = tokenfile.WholeEncoder(model, "<u2")
    assert encoder.encode(texts) == whole.encode(texts)
    assert sorted(asked) == sorted(["ciudád", "$$$", "&&&", ".%%%", "ŝtono"])
    assert encoder.encode(texts[::-1]) == whole.encode(texts[::-1]) and len(asked) == 5


def test_marks_and_cases_of_all_letters_encode_like_whole_texts(monkeypatch):
    model = open(TOKENIZER, encoding="utf-8").read()
    characters = [chr(c) for c in [*range(0x20, 0x300), *range(0x2000, 0x2070), 0x20AC, 0x2126, 0x212A, 0x2160, 0x958, 0x9DF, 0xA36, 0xFB1D]]
    texts = [f"{c}a B{c} É{c}, x{c}y {c}" for c in characters] + [f"wörd{a}{b} Wörd{a}{b}s wörd{a}{b}" for a in "'<|>.$`\\" for b in "'<|>.$`\\s"]
    whole = tokenfile.WholeEncoder(model, "<u2").encode(texts)
    assert tokenfile.WordEncoder(model, "<u2").encode(texts) == whole
    # words are forgotten and met again
    monkeypatch.setattr(tokenfile, "REMEMBERED_WORDS", 50)
    encoder = tokenfile.WordEncoder(model, "<u2")
    for _ in range(2):
        assert [x for a, b in tokenfile.together(texts, 300) for x in encoder.encode(texts[a:b])] == whole
    assert len(encoder.numbers) < len(texts)


def test_texts_are_taken_together_up_to_a_size():
    assert list(tokenfile.together(["aa", "b", "cccc", "", "d"], 3)) == [(0, 2), (2, 3), (3, 5)]
    assert list(tokenfile.together([], 3)) == [] and list(tokenfile.together([""], 3)) == [(0, 1)]


def test_damaged_records_are_refused():
    good = tokenfile.frame(tokenfile.pack(7, np.array([1, 2], "<u2").tobytes(), False))
    assert tokenfile.unpack(tokenfile.unframe(good))[1].tolist() == [1, 2]
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(tokenfile.CorruptRecord):
            tokenfile.unframe(bytes(bad))
    with pytest.raises(tokenfile.CorruptRecord):
        tokenfile.unframe(good[:-1])


def test_empty_table_gives_an_empty_index(spark, odd):
    folder = new_folder(spark, "tokens")
    assert tokenfile.write(odd.limit(0), TOKENIZER, folder).count() == 0 and tokenfile.read(spark, folder).count() == 0


# line templates


def test_recurring_templates_are_dropped_with_their_variable_fields(spark):
    body = lambda i: "\n".join(f"{w}{i} quite own words{j} here {w}" for j, w in enumerate("abc"))
    rows = [(i, f"Page {i} of the {chr(97 + i % 26)}{chr(97 + i // 26)} report here\n{body(i)}\n\nAll rights reserved by us") for i in range(40)]
    got = linetemplates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_texts=10).collect()
    # the lines of the body recur as templates too: their own words have digits
    assert all(r.n_lines == 6 and r.n_dropped == 5 and r.kept_text == "" for r in got)
    plain = [(i, "\n".join([f"the {' '.join(np.random.default_rng(i).choice(list('bcdfghjklmnp'), 9))}", "Released under the old licence", "short one"])) for i in range(30)]
    got = linetemplates.drop_lines(spark.createDataFrame(plain, "doc_id long, text string"), min_texts=25).collect()
    assert all(r.n_dropped == 1 and r.kept_text == r.text.replace("Released under the old licence\n", "") for r in got)


def test_copies_count_once_and_line_cases(spark, odd):
    docs = spark.createDataFrame([(i, "one line of many copies here") for i in range(50)], "doc_id long, text string")
    assert linetemplates.drop_lines(docs, min_texts=2).where("n_dropped > 0").count() == 0
    got = linetemplates.drop_lines(odd, min_texts=2)
    assert got.count() == odd.count() and got.where("text IS NULL AND kept_text IS NULL AND n_lines = 0").count() == 2
    assert linetemplates.drop_lines(odd.limit(0)).count() == 0


def test_short_and_long_lines_recur_literally(spark):
    long, own = "w " * 49 + "end", lambda i: " ".join(f"own{chr(97 + i)}{c}" for c in "abcde")
    rows = [(i, "\n".join([own(i), "Les.", " 12\t", *[long] * (i < 3)])) for i in range(12)] + [(12, own(12) + "\n13"), (13, own(13) + "\nFew.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in linetemplates.drop_lines(docs, literal_tokens=1).collect()}
    assert got == {i: own(i) for i in range(12)} | {12: own(12) + "\n13", 13: own(13) + "\nFew."}
    # without it short lines stay
    assert linetemplates.drop_lines(docs).where("n_dropped > 0").count() == 3
    two = linetemplates.drop_lines(docs.where("doc_id > 0"))
    assert two.where("n_dropped > 0").count() == 0


def test_a_text_counts_once_for_a_template(spark):
    log = "\n".join(f"the same start {w}" for w in "abcdefghij")
    rows = [(0, log), (1, "something else"), *[(i, f"a line seen in {chr(97 + i)}") for i in range(2, 14)]]
    got = {r.doc_id: r.n_dropped for r in linetemplates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0} | {i: 1 for i in range(2, 14)}


# Jaccard join


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc_id)
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


@pytest.mark.parametrize("chunk", [4_096, 7])
def test_components_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(paritysketch, "CHUNK_SETS", chunk)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    docs, passage = [], rng.choice(words, 40).tolist()
    for base in range(40):
        text = rng.choice(words, int(rng.integers(6, 160))).tolist()
        for copy in range(int(rng.integers(1, 6))):
            new = list(text)
            for _ in range(int(rng.integers(0, max(1, len(text) // 25) + 1))):
                new[int(rng.integers(len(new)))] = "edit" + str(rng.integers(1_000))
            docs.append((len(docs) * 3 % 1_009, " ".join(new + (passage if copy == 3 else []))))
    # a chain whose ends are not alike, and groups around the bound
    chain = rng.choice(words, 80).tolist()
    for step in range(6):
        docs.append((2_000 + step, " ".join(chain[step * 6 :] + rng.choice(words, step * 6).tolist())))
    got = paritysketch.cluster(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(docs)


def test_join_cases(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = paritysketch.cluster(odd)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(docs)
    kept = rows_of(paritysketch.keep_one(odd), "doc_id", "text")
    assert len(kept) == len({d for d, _ in docs if d not in (4, 5, None)}) + 2
    assert paritysketch.cluster(odd.limit(0)).count() == 0


def test_near_copies_under_null_and_repeated_ids_are_linked(spark):
    text = [f"t{i}" for i in range(100)]
    edited = " ".join([*text[:99], "x"])
    docs = [(None, " ".join(text)), (None, edited), (7, "quite another thing altogether my friend"), (7, " ".join(["x", *text[1:]]))]
    got = paritysketch.cluster(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(docs)


@pytest.mark.parametrize("chunk", [1_024, 3])
def test_all_links_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(paritysketch, "ALL_CHUNK_SETS", chunk)
    text = [f"t{i}" for i in range(100)]
    docs = [(i, " ".join([*text[:99], f"x{i}"])) for i in range(8)] + [(8, " ".join(text[:20])), (9, " ".join(text[:21])), (10, " ".join(text[40:])), (11, " ".join(text[40:])), (12, "")]
    members, links, label = paritysketch.join(spark.createDataFrame(docs, "doc_id long, text string"))
    node = {r.doc_id: r.node for r in members.collect()}
    sets = {node[i]: shingle_set(t) for i, t in docs if t}
    want = {frozenset((a, b)): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = links.collect()
    assert len(want) == 29 and len(got) == 29 and {frozenset((r.a, r.b)): r.both for r in got} == want
    comp = {r.node: r.comp for r in label.collect()}
    assert len({comp[node[i]] for i in range(8)}) == 1 and comp[node[8]] == comp[node[9]]


def test_one_of_each_group_is_kept_under_null_and_repeated_ids(spark):
    text = [f"t{i}" for i in range(100)]
    near = lambda i: " ".join([*text[:99], f"x{i}"])
    other = "quite another thing altogether my friend"
    docs = [(1, near(1)), (1, other), (1, other), (2, near(2)), (None, near(3)), (None, "nothing like it in here at all"), (None, "nothing like it in here at all"), (None, ""), (None, None), (4, " "), (5, other), (3, near(4))]
    got = paritysketch.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    want = [(1, near(1)), (1, other), (None, "nothing like it in here at all"), (None, ""), (None, None), (4, " ")]
    assert rows_of(got, "doc_id", "text") == sorted(want, key=repr)


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64))
    nodes, needs = rng.integers(0, 20, 500).astype(np.uint64), np.zeros(500, np.int32)
    back = paritysketch.unpack(paritysketch.pack(keys, nodes, needs))
    assert all((a == b).all() for a, b in zip(back, (keys, nodes, needs), strict=True))


def test_sketch_distance_bounds_the_symmetric_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(20, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: int(len(a) * 0.9)], rng.integers(0, 2**63, 5).astype(np.uint64))))
        floor = np.array([64])
        one = set(paritysketch.parts(a, np.array([len(a)]), np.zeros(len(a), int), floor)[0].tolist())
        two = set(paritysketch.parts(b, np.array([len(b)]), np.zeros(len(b), int), floor)[0].tolist())
        assert len(one - two) <= len(np.setxor1d(a, b))


def test_sets_send_no_more_parts_than_a_link_needs():
    rng = np.random.default_rng(9)
    mixed = lambda n: shingles.mix(rng.integers(0, 2**63, n).astype(np.uint64))
    linked = 0
    for _ in range(300):
        common = mixed(int(rng.integers(3, 1_500)))
        more = max(1, len(common) // 4)
        pair = [np.unique(np.concatenate((common, mixed(int(rng.integers(0, more)))))) for _ in range(2)]
        bounds = np.cumsum([0, *map(len, pair)])
        keys, owner, need = paritysketch.bands(np.concatenate(pair), bounds, 75)
        for n, i in ((len(pair[0]), 0), (len(pair[1]), 1)):
            floor = 1 << (n.bit_length() - 1)
            # of its own band and the one below: those that may differ, and an 8th of the floor or 8
            assert (owner == i).sum() <= sum((25 * (n + n * 100 // 75) // 175, max(8, floor // 8))) + (n + floor) // 7 + max(8, floor // 16)
        both = len(np.intersect1d(*pair))
        if 100 * both >= 75 * (len(pair[0]) + len(pair[1]) - both) and len(pair[0]) != both != len(pair[1]):
            linked += 1
            # in one band they share as many parts as each needs there
            shared = np.intersect1d(keys[owner == 0], keys[owner == 1])
            needs = [need[owner == i][np.isin(keys[owner == i], shared)] for i in (0, 1)]
            assert len(shared) and all(any((x == k).sum() >= k for k in set(x.tolist())) for x in needs)
    assert linked > 50


def test_blocks_of_many_buckets_stay_small():
    rng = np.random.default_rng(10)
    nodes = rng.integers(0, 2**63, 8_000).astype(np.uint64)
    of = np.repeat(np.arange(8_000), 3)
    keys = shingles.mix(rng.integers(0, 2**63, len(of)).astype(np.uint64)) & paritysketch.KEY_BITS
    # keys of 48 bits, ascending, the place of their set, and sets that ascend too
    assert len(paritysketch.pack(keys, nodes[of], np.full(len(of), 8))) < 8.8 * len(of)


def test_a_common_passage_joins_no_families(spark):
    rng = np.random.default_rng(11)
    # pairs of sets with 10 parts of their own and 5 that all have, where 8 are needed
    keys = np.sort(rng.choice(2**40, 10 * 20 + 5, replace=False).astype(np.uint64) << np.uint64(16))
    common, own = keys[::41], np.setdiff1d(keys, keys[::41]).reshape(20, 10)
    rows = [(k, 2 * pair + side + 1) for pair in range(20) for side in (0, 1) for k in [*own[pair], *common]]
    k, n = (np.array(x, np.uint64) for x in zip(*rows, strict=True))
    half = np.arange(len(k)) % 2 == 0
    blocks = [(bytearray(paritysketch.pack(k[x], n[x], np.full(x.sum(), 8))),) for x in (half, ~half)]
    stars = paritysketch.stars(spark.createDataFrame(blocks, "data binary"), 8).collect()
    assert sorted((r.b, r.a) for r in stars) == [(2 * pair + 1, 2 * pair + 2) for pair in range(20)]


@pytest.mark.parametrize("percent", [75, 50, 100])
def test_chunks_far_apart_in_size_do_not_meet(spark, percent):
    rng = np.random.default_rng(12)
    sizes = [2**i for i in range(14)] + np.exp(rng.uniform(0, 9, 180)).astype(int).tolist()
    rows = [(i, 0, 1, int(n), 100) for i, n in enumerate(sizes)] + [(1_000 + i, 0, 2, 50, 100) for i in range(8)]
    members = spark.createDataFrame(rows, "node long, comp long, family long, n long, bytes long")
    got = {r.node: r for r in paritysketch.dealt(members, percent, 10).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    for i, a in enumerate(sizes):
        for j, b in enumerate(sizes):
            if 100 * min(a, b) >= percent * max(a, b):
                assert got[j].place in got[i].others
    assert all(len(set(r.others)) == len(r.others) and r.place in r.others for r in got.values())
    # 194 sets are 20 chunks at least, and each set met all of them
    assert percent == 50 or sum(len(got[i].others) for i in range(len(sizes))) < 10 * len(sizes)
    assert all(r.others == [r.place] for r in got.values() if r.family == 2)


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    conf, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(20).selectExpr("id AS doc_id", "concat('w', id) AS text")
    was = spark.conf.get(conf)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(conf, given)
            paritysketch.sketch(docs, 75, 4)
            assert spark.conf.get(conf) == want
    finally:
        spark.conf.set(conf, was)
    monkeypatch.setattr(shingles, "PIECE_ROWS", 3)
    column = pa.array(["a", None, "bc", "", "ü", "d", "e"])
    assert list(shingles.pieces(column)) == [(0, [b"a", b"", b"bc"]), (3, [b"", "ü".encode(), b"d"]), (6, [b"e"])]


def test_other_work_lets_go_of_the_encoder(spark):
    class Docs:
        """Runs a task's function here."""

        columns, sparkSession, schema = ["doc_id", "text"], spark, spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two"])], ["doc_id", "text"])])))

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    for work in (lambda: paritysketch.sketch(Docs(), 75, 4), lambda: langid.identify(Docs(), {"en": b"the and of"})):
        encoder = tokenfile.encoder_of(model, "<u2")
        assert tokenfile.encoder_of(model, "<u2") is encoder and list(WORKER_HELD.values()) == [encoder]
        assert work()
        assert not WORKER_HELD


def test_shingles_equal_brute_force():
    texts = ["", " ", "a b", "a  b\n", "A", "a b c d e", "a b c d E f", "é ß ñ ü ö", LONG, "\ta\x0bb\x0cc\rd e f g"]
    hashes, bounds = shingles.sets([t.encode() for t in texts])
    assert np.diff(bounds).tolist() == [len(shingle_set(t)) for t in texts]
    assert hashes[bounds[2] : bounds[3]].tolist() == hashes[bounds[3] : bounds[4]].tolist()


# language ID


def test_language_is_told_by_compression(spark, odd):
    rng = np.random.default_rng(6)
    parts = {"aa": ["tion", "the", "ing", "ough"], "bb": ["sch", "ung", "keit", "ein"], "cc": ["eaux", "que", "oi", "ment"]}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k], 3)) for _ in range(n))
    rows = [(i, say(k, int(rng.integers(20, 400))), k) for i in range(300) for k in [sorted(parts)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = langid.train(docs.where("doc_id < 150"))
    assert sorted(dictionaries) == ["aa", "bb", "cc"]
    got = langid.identify(docs.where("doc_id >= 150"), dictionaries)
    assert got.where("lang_pred = lang AND NOT rejected").count() == 150 and got.where("score < 0.5 OR score > 1").count() == 0
    out = langid.identify(odd, dictionaries)
    assert out.count() == odd.count() and "score_in" in out.columns
    assert out.where("lang_pred = 'und' AND rejected AND score = 0").count() == 5
    assert langid.identify(odd.limit(0), dictionaries).count() == 0
    assert langid.identify(odd, {}).where("lang_pred != 'und'").count() == 0
    assert langid.train(odd.limit(0)) == {}
    assert langid.identify(docs, {"aa": b"x y z"}).where("lang_pred = 'aa' AND score = 1.0").count() == 300
