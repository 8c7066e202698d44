"""Spelling variants: words one edit apart, found by search schemes on bidirectional FM-indexes.

A pattern is cut into two halves. One edit leaves a half as it is, so two searches find all words one edit away: match the
first half exactly and extend to the right allowing one error, or match the second half exactly and extend to the left. Both run on
an index over the text ``|word|word|...|`` that knows the rank interval of the current string among the sorted suffixes of the
text and of the reversed text, and so can grow it at either end; the delimiters anchor the words.

The vocabulary is never in one place. A pattern and a word that share an exact half are sent to the same shard by its hash: a pattern
under its own half, a word under the halves that patterns one shorter, equal or one longer would share with it. Each shard is indexed
and searched by itself, and gives one row a pattern (number of near words, the most frequent one), so pairs never leave
it. Shards are counted; one beyond ``CROWDED`` times the intended size (a half that very many words share) is cut into a grid of (patterns, words) blocks.

Cases: null and empty texts have no words; a null id counts as the empty text; repeated rows count as often as they stand; ties in
frequency go to the smaller word in code-point order; a very long run of letters is a word like any other; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import ascii_lower
from sigspark.session import stage

RUN = r"[A-Za-zÀ-ÿ]"
# Symbols of text in the index of one shard.
SHARD_SYMBOLS = 65_536
CROWDED = 4
# Patterns that are searched at once.
TOGETHER = 2_048


# the index


def sorted_suffixes(text: np.ndarray, longest: int) -> np.ndarray:
    """Start positions of the suffixes, sorted by their first ``longest`` symbols at least (prefix doubling)."""
    n = len(text)
    # several symbols in one number to begin with; the end of the text sorts before every symbol
    bits = int(text.max() + 1).bit_length()
    width = max(1, 62 // bits)
    padded = np.concatenate([text + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = (key << bits) | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if width >= longest or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:] + 1
        key = rank * (n + 1) + after
        width *= 2


class Ranks:
    """How often each symbol precedes the first i sorted suffixes."""

    def __init__(self, text: np.ndarray, symbols: int, longest: int):
        self.suffixes = sorted_suffixes(text, longest)
        before = text[self.suffixes - 1]
        table = np.zeros((len(text) + 1, symbols + 1), np.int32)
        table[np.arange(1, len(text) + 1), before + 1] = 1
        np.cumsum(table, axis=0, out=table)
        np.cumsum(table, axis=1, out=table)
        # [i, c]: symbols smaller than c among the first i
        self.table = table
        self.first = table[-1].astype(np.int64)


class BidirectionalIndex:
    """Rank intervals of a string in a text and of its mirror image in the mirrored text."""

    def __init__(self, text: np.ndarray, longest: int):
        self.text, self.symbols = text, int(text.max()) + 1
        self.forward = Ranks(text, self.symbols, longest)
        self.mirror = Ranks(text[::-1].copy(), self.symbols, longest)

    def grow(self, lo, mlo, size, symbol, right: bool):
        """The intervals after one symbol more at the right or left end."""
        ranks, a, b = (self.mirror, mlo, lo) if right else (self.forward, lo, mlo)
        smaller = ranks.table[a, symbol]
        upto = ranks.table[a + size, symbol]
        inside = ranks.table[a, symbol + 1] - smaller
        a2 = ranks.first[symbol] + inside
        size2 = (ranks.table[a + size, symbol + 1] - upto) - inside
        b2 = b + (upto - smaller)
        return (b2, a2, size2) if right else (a2, b2, size2)

    def next_symbols(self, lo, mlo, size, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) of every symbol but the delimiter that occurs at that end."""
        ranks, a = (self.mirror, mlo) if right else (self.forward, lo)
        counts = np.diff(ranks.table[a + size] - ranks.table[a], axis=1)
        counts[:, 0] = 0
        return np.nonzero(counts)


def one_edit_away(index: BidirectionalIndex, starts: np.ndarray, lengths: np.ndarray, patterns: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (pattern, word) one edit apart that share the pattern's first half (``side`` "prefix") or its second half but not the first.

    Words are numbered by their order in the text. The exact half is matched towards its end of the word, delimiter included, then the
    search turns and grows over the other half.
    """
    text, prefix = index.text, side == "prefix"
    half = lengths // 2
    found = []
    for begin in range(0, len(patterns), TOGETHER):
        p = patterns[begin : begin + TOGETHER]
        start, m, h = starts[p], lengths[p], half[p]
        rest = m - h if prefix else h  # symbols of the half that may differ
        # symbol number t of the exact half, from the cut outward; beyond it the delimiter, which is its neighbour in the text
        lo, mlo, size = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.full(len(p), len(text))
        exact = m - rest
        for t in range(int(exact.max()) + 1):
            on = np.nonzero(t <= exact)[0]
            symbol = text[start[on] + h[on] - 1 - t] if prefix else text[start[on] + h[on] + t]
            lo[on], mlo[on], size[on] = index.grow(lo[on], mlo[on], size[on], symbol, right=not prefix)
        # symbol number i of the other half, from the cut outward; at ``rest`` the delimiter
        wanted = (lambda who, i: text[start[who] + h[who] + i]) if prefix else (lambda who, i: text[start[who] + h[who] - 1 - i])
        who, at = np.arange(len(p)), np.zeros(len(p), np.int64)
        erred = [np.zeros(0, np.int64)] * 5  # who, at, lo, mlo, size after the error
        while len(who) or len(erred[0]):
            # after the error: exactly to the delimiter
            w, i, l1, m1, s1 = erred
            symbol = wanted(w, i)
            l1, m1, s1 = index.grow(l1, m1, s1, symbol, right=prefix)
            there = (s1 > 0) & (i == rest[w])
            found.append((p[w[there]], l1[there]))
            on = (s1 > 0) & (i < rest[w])
            erred = [w[on], i[on] + 1, l1[on], m1[on], s1[on]]
            if not len(who):
                continue
            inner = at < rest[who]
            more = [[x] for x in erred]

            def add(*columns, more=more):
                for x, c in zip(more, columns, strict=True):
                    x.append(c)

            # the word lacks the symbol
            add(who[inner], at[inner] + 1, lo[inner], mlo[inner], size[inner])
            # the word has another symbol in its place, or one more before it
            state, symbol = index.next_symbols(lo, mlo, size, right=prefix)
            l2, m2, s2 = index.grow(lo[state], mlo[state], size[state], symbol, right=prefix)
            want = wanted(who[state], at[state])
            other = symbol != want
            add(who[state][other], at[state][other], l2[other], m2[other], s2[other])
            other &= inner[state]
            add(who[state][other], at[state][other] + 1, l2[other], m2[other], s2[other])
            erred = [np.concatenate(x) for x in more]
            same = (symbol == want) & inner[state]
            who, at, lo, mlo, size = who[state][same], at[state][same] + 1, l2[same], m2[same], s2[same]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pattern = np.concatenate([x for x, _ in found])
    # the interval of a whole word with both delimiters holds one suffix, which begins at the delimiter before it
    word = np.searchsorted(starts, index.forward.suffixes[np.concatenate([x for _, x in found])] + 1)
    once = np.unique(pattern * len(starts) + word)
    pattern, word = once // len(starts), once % len(starts)
    if not prefix:
        # the other search has those that share the first half
        alike = lengths[word] >= half[pattern]
        for t in range(int(half[pattern].max(initial=0))):
            on = np.nonzero(alike & (t < half[pattern]))[0]
            alike[on] = text[starts[word[on]] + t] == text[starts[pattern[on]] + t]
        pattern, word = pattern[~alike], word[~alike]
    return pattern, word


# over Spark


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 7, min_count: int = 2, misspell: int = 31) -> DataFrame:
    """(word, n): runs of letters, lower-cased A-Z, of all documents.

    With ``misspell`` a run whose hash with the document id is divisible by it loses one code point (a deterministic typing error).
    """
    # a code point at most is lost, so shorter runs cannot count
    runs = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN}{{{min_chars},}})"), F.lit(1)))
    words = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), runs.alias("w")).select("d", ascii_lower(F.col("w")).alias("w"))
    h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    spelt = F.when(F.col("h") % misspell == 0, cut).otherwise(F.col("w"))
    return words.select("w", h.alias("h")).select(spelt.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= min_chars) & (F.col("n") >= min_count))


def _routes(side: str) -> Column:
    """Halves under which a word is looked for, as lengths: its own first, then that of patterns one longer or shorter."""
    m = F.length("word")
    part = (lambda x: F.floor(x / 2)) if side == "prefix" else (lambda x: x - F.floor(x / 2))
    return F.array_distinct(F.array(part(m), part(m - 1), part(m + 1)).cast("array<int>"))


def shards_of(vocab: DataFrame, shard_symbols: int) -> DataFrame:
    """(side, shard, row, block, word, n, pattern, target): who meets whom; ``vocab`` is a written table."""
    sides = []
    # a word stands in two shards of a side
    symbols = vocab.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    shards = max(1, math.ceil(2 * symbols / shard_symbols))
    for side in ("prefix", "suffix"):
        rows = vocab.select("word", "n", F.posexplode(_routes(side)).alias("pos", "len"))
        half = F.left("word", F.col("len")) if side == "prefix" else F.right("word", F.col("len"))
        sides.append(rows.select(F.lit(side).alias("side"), F.pmod(F.xxhash64(half), F.lit(shards)).alias("shard"), "word", "n", (F.col("pos") == 0).alias("pattern")))
    met = sides[0].unionByName(sides[1])
    load = met.groupBy("side", "shard").agg(F.sum(F.length("word") + 1).alias("symbols"))
    crowded = load.where(F.col("symbols") > CROWDED * shard_symbols).select("side", "shard", F.ceil(F.col("symbols") / shard_symbols).cast("int").alias("blocks"))
    if crowded.isEmpty():
        return met.select("side", "shard", F.lit(0).alias("row"), F.lit(0).alias("block"), "word", "n", "pattern", F.lit(True).alias("target"))
    dealt = met.join(crowded, ["side", "shard"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = ["side", "shard", "row", "block", "word", "n", "pattern", "target"]
    # as a word in its block for all rows of patterns, as a pattern in its row for all blocks
    words = dealt.withColumn("row", every).withColumn("block", mine).withColumn("target", F.lit(True)).withColumn("pattern", F.lit(False))
    patterns = dealt.where("pattern").withColumn("block", every).withColumn("row", mine).withColumn("target", F.lit(False))
    return words.select(*cols).unionByName(patterns.select(*cols))


def _searched(group: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, their counts, which are patterns, and the pairs found) of one shard."""
    seen: dict[str, list] = {}
    for word, n, pattern, target in zip(*(group.column(c).to_pylist() for c in ("word", "n", "pattern", "target")), strict=True):
        was = seen.setdefault(word, [n, False, False])
        was[1], was[2] = was[1] or pattern, was[2] or target
    words = sorted(seen)  # numbers in code-point order
    n, pattern, target = (np.array([seen[w][i] for w in words]) for i in range(3))
    lengths = np.array([len(w) for w in words])
    joined = "\0" + "\0".join(words) + "\0"
    _, text = np.unique(np.frombuffer(joined.encode("utf-32-le"), np.uint32), return_inverse=True)
    starts = np.concatenate([[1], 1 + np.cumsum(lengths + 1)[:-1]])
    index = BidirectionalIndex(text.astype(np.int64), int(lengths.max()) + 3)
    a, b = one_edit_away(index, starts, lengths, np.nonzero(pattern)[0], group.column("side")[0].as_py())
    keep = target[b]
    return words, n, pattern, a[keep], b[keep]


def near_pairs(vocab: DataFrame, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(word, near): all ordered pairs one inserted, deleted or replaced code point apart; ``vocab`` (word, n) is a written table."""

    def run(group: pa.Table) -> pa.Table:
        words, _, _, a, b = _searched(group)
        return pa.table({"word": pa.array([words[i] for i in a], pa.string()), "near": pa.array([words[i] for i in b], pa.string())})

    return shards_of(vocab, shard_symbols).groupBy("side", "shard", "row", "block").applyInArrow(run, "word string, near string")


def near_words(vocab: DataFrame, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(word, n, n_near, near, near_n): how many words are one edit away, and the most frequent of them."""

    def run(group: pa.Table) -> pa.Table:
        words, n, pattern, a, b = _searched(group)
        count = np.bincount(a, minlength=len(words))
        best = np.full(len(words), -1)
        order = np.lexsort((b, -n[b], a))
        first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
        best[a[first]] = b[first]
        asked = np.nonzero(pattern)[0]
        pick = [int(best[i]) for i in asked]
        return pa.table({
            "word": pa.array([words[i] for i in asked], pa.string()), "n": pa.array(n[asked], pa.int64()), "n_near": pa.array(count[asked], pa.int64()),
            "near": pa.array([words[i] if i >= 0 else None for i in pick], pa.string()), "near_n": pa.array([int(n[i]) if i >= 0 else None for i in pick], pa.int64()),
        })

    told = shards_of(vocab, shard_symbols).groupBy("side", "shard", "row", "block").applyInArrow(run, "word string, n bigint, n_near bigint, near string, near_n bigint")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    out = told.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def group_variants(vocab: DataFrame, ratio: int = 10, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocab`` (word, n).

    ``form`` is the most frequent near word if it stands at least ``ratio`` times as often. Forms grow by that ratio, so the chain to the
    root is bounded by the logarithm of the largest count, and pointer doubling by the logarithm of that.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: chains of forms would not end")
    vocab = stage(vocab, "vocabulary")
    near = near_words(vocab, shard_symbols)
    formed = F.col("near_n") >= ratio * F.col("n")
    words = stage(near.select("word", F.when(formed, F.col("near")).alias("form"), "n", "n_near", F.when(formed, F.col("near_n")).alias("form_n")), "variants")
    span = vocab.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = int(math.log(span.most / span.least, ratio) + 1e-9) if span.most else 0
    links = words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    out = words.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
