"""Chat formatting, spelling variants and centroid clustering against brute force, with the cases of their docstrings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspark.llm import centroids, chatformat, queries, variants
from sigspark.session import stage, table

# chat formatting

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<", "[", "/", "\\", "s>", "INST]", "ROLE]", "a", " ", "\n", "é", "𝄞"]
hostile = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), hostile), hostile), max_size=5))
def test_any_turns_come_back(turns):
    formatted, spans = chatformat.write_turns(turns)
    assert [(r, t) for r, t, _, _ in chatformat.LLAMA_LIKE.parse(formatted)] == turns
    assert [chatformat.LLAMA_LIKE.unshield(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_only_conflicting_texts_are_escaped():
    assert chatformat.write_turns([("user", r"a\b <b> [x] s> \\")]) == (r"<s>[INST]a\b <b> [x] s> \\</s>", [])
    assert chatformat.write_turns([("user", "</s>"), ("assistant", r"<\/s>")])[0] == r"<s>[INST]<\/s></s><s>[/INST]<\\/s></s>"


@pytest.mark.parametrize("text", ["x", "<s>[INST]a", "<s>[INST]<s></s>", "<s>a</s>", "<s>[INST]a</s> "])
def test_texts_outside_the_grammar_are_refused(text):
    with pytest.raises(chatformat.NotInGrammar):
        chatformat.LLAMA_LIKE.parse(text)


def test_templates_without_a_clear_grammar_are_refused():
    for odd in ({"begin": "s"}, {"end": "[x[y]"}, {"end": "<s>"}, {"begin": "<\\s>"}):
        with pytest.raises(ValueError):
            chatformat.Template(**odd)


def told(rows):
    """Brute-force digests of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_chars", [1_000_000, 300])
def test_chats_with_nulls_ties_copies_and_a_hot_conversation(spark, part_chars):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), "".join(rng.choices(PIECES, k=rng.randint(0, 30)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(7, t, "assistant", f"line {t} </s>") for t in range(600)]  # more than a third of all rows
    rows += [(8, 1, "user", None), (8, None, "user", "first"), (8, 1, "user", "same"), (8, 1, "user", "same"), (None, 0, "assistant", "nobody"), (None, None, None, None), (9, 0, "user", "word " * 40_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int")
    parts = stage(chatformat.format_chats(df, part_chars=part_chars), "chats")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chatformat.digest(parts).collect()}
    assert got == told(rows)
    if part_chars == 300:
        assert parts.where("conv_id = 7").count() > 20
    assert chatformat.digest(stage(chatformat.format_chats(df.limit(0)), "chats")).count() == 0


# spelling variants


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_variants(n):
    rows, forms = {}, {}
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        if close and n[close[0]] >= 10 * n[w]:
            forms[w] = close[0]
        rows[w] = [forms.get(w), None, n[w], len(close), n[forms[w]] if w in forms else None]
    for w, row in rows.items():
        root = w
        while root in forms:
            root = forms[root]
        row[1] = root
    return {w: tuple(r) for w, r in rows.items()}


def family(rng, alphabet, lengths, size, edits):
    words = {"".join(rng.choices(alphabet, k=rng.choice(lengths))) for _ in range(size)}
    for w in list(words):
        for _ in range(edits):
            i = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:i] + rng.choice(alphabet) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i + 1 :]]))
    return {w for w in words if len(w) >= 2}


@pytest.mark.parametrize(("alphabet", "lengths"), [("ab", [7, 8, 9]), ("abcdefgh", [7, 12, 20]), ("aé÷𝄞", [2, 3, 4, 60])])
@pytest.mark.parametrize("shard_symbols", [10**6, 400])
def test_near_pairs_equal_brute_force(spark, alphabet, lengths, shard_symbols):
    words = sorted(family(random.Random(5), alphabet, lengths, 60, 3))
    vocab = stage(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), "vocab")
    got = [(r.word, r.near) for r in variants.near_pairs(vocab, shard_symbols).collect()]
    want = {(a, b) for a in words for b in words if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_half_that_all_words_share_is_dealt_into_blocks(spark):
    rng = random.Random(6)
    words = sorted({"stationary" + "".join(rng.choices("abc", k=5)) for _ in range(200)} | {"".join(rng.choices("abc", k=5)) + "stationary" for _ in range(200)})
    counts = {w: rng.choice([2, 3, 40, 500]) for w in words}
    vocab = stage(spark.createDataFrame(list(counts.items()), "word string, n long"), "vocab")
    met = variants.shards_of(vocab, 500)
    assert met.select("row", "block").distinct().count() > 4
    assert max(r["count"] for r in met.groupBy("side", "shard", "row", "block").count().collect()) < len(words)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(vocab, shard_symbols=500).collect()}
    assert got == brute_variants(counts)


def test_variants_of_odd_documents_equal_brute_force(spark):
    rng = random.Random(7)
    words = sorted(family(rng, "abcdé", [6, 7, 9], 30, 4)) + ["Émigrées", "ÀÿÀÿÀÿÀ", "a×b÷cde", "MIXEDcase"]
    docs = [(i, " ".join(rng.choices(words[:8] * 20 + words, k=60)) + rng.choice(["", "!", "\n7x", " 𝄞longword𝄞"])) for i in range(120)]
    docs += [(None, "mixedcase mixedcase mixedcases"), (5, None), (6, ""), *docs[:3], *docs[:1] * 4, (900, "mixedcases " * 5_000 + "z" * 3_000), (901, "z" * 3_000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(variants.vocabulary(df), shard_symbols=2_000).collect()}
    want = brute_variants(brute_words(docs))
    assert got == want
    assert any(f and f != r for f, r, *_ in want.values()) or any(f for f, *_ in want.values())
    assert variants.group_variants(variants.vocabulary(df.limit(0))).count() == 0


def test_chains_of_forms_lead_to_the_root(spark):
    counts = {"a" * 7 + "b" * i: 3 * 10**i for i in range(7)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r.root for r in variants.group_variants(vocab).collect()}
    assert set(got.values()) == {"a" * 7 + "b" * 6} and len(got) == 7
    with pytest.raises(ValueError):
        variants.group_variants(vocab, ratio=1)


def test_variants_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_fm_variants(spark, sf).collect()}
    n = brute_words(docs)
    by_gap = {}  # words with one code point left out meet all near words
    for w in n:
        for i in range(len(w)):
            by_gap.setdefault(w[:i] + "\0" + w[i + 1 :], set()).add(w)
            by_gap.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        by_gap.setdefault(w, set()).add(w)
    close = {w: set() for w in n}
    for met in by_gap.values():
        for a in met:
            close[a] |= {b for b in met if b not in close[a] and near(a, b)}
    assert set(got) == set(n) and all(got[w][2:4] == (n[w], len(close[w])) for w in n)
    for w, (form, root, _, _, form_n) in got.items():
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        want = best if best and n[best] >= 10 * n[w] else None
        assert (form, form_n) == (want, n[want] if want else None) and (root == w if form is None else root == got[form][1])


# centroid clustering


def brute_means(rows, k, rounds, seed, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centre = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for j in set(mine):
            group = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            centre[j] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centre[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_clusters_equal_brute_force_with_ties_copies_and_odd_vectors(spark, k):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(150)]
    rows += [(1_000 + i, [0.5] * 8) for i in range(90)] + [rows[3], rows[3], (4, [0.25] * 8), (None, [0.125] * 8), (None, [1.0] * 8)]
    rows += [(2_000, None), (2_001, []), (2_002, [0.0] * 7), (2_003, [None] + [0.0] * 7), (2_004, [float("nan")] + [0.0] * 7), (2_005, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, inertia string")
    got = centroids.cluster(df, k=k, dimensions=8).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_means(rows, k, 5, 2, 256)


def test_the_walk_stops_early_and_breaks_ties_by_number():
    c = np.array([[0, 0], [10, 10], [10, 10], [-10, 4]])
    who, best = centroids.nearest_centroid(np.array([[10, 10], [5, 5], [0, 1], [-10, 4], [2**27, -(2**27)]]), c)
    assert who.tolist() == [1, 0, 0, 3, 0] and best.tolist() == [0, 50, 1, 0, 2**55]


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 8), (2, [1e300] * 8)], "vec_id int, embedding array<double>")
    got = {r.vec_id: (r.distance, r.cluster_inertia) for r in centroids.cluster(df, dimensions=8).collect()}
    assert got == {1: (0, 0), 2: (0, 0)}
    none = centroids.cluster(df.limit(0), dimensions=8)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
