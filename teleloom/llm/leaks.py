"""Test passages in training texts: a BM25 inverted index of the items, searched by block-max WAND, then verified.

Index terms are pairs of neighbouring words, so that common words weigh little and the order counts. Every training
text is cut into overlapping passages; each is a query against all items. A query keeps a cursor in each of its terms'
postings, which are in order of items and cut into blocks. WAND: the cursors, in order of the items they stand at,
add up their terms' greatest impacts until the threshold can be reached; that is the pivot, and no item before it can
be a result. Block-max: the greatest impacts of the blocks the pivot lies in must reach the threshold too, else
the cursors jump past the end of these blocks without looking into them. Only then is the pivot scored.

The threshold is each item's own: the least score that a passage of 20 of its words can have after the edits allowed.
Impacts are stored as shares of it, so that the threshold of every item is 1 and nothing of 20 words is missed,
however long the item is and however many there are. All items at or above it are then aligned word by word with the
text around the passage, and count as leaked if enough consecutive words agree that are not wording many items share.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teleloom.plans.storage import Workspace, spread

#: Most items and most characters of items one broadcast index may hold; more are searched in that many parts.
MOST_ITEMS, MOST_CHARS = 20_000, 20_000_000
WINDOW, STEP, BLOCK = 48, 24, 8
#: A leak has so many consecutive words, so many edits a word at most (what a passage may have and still be found is
#: one word in eight), and so many equal words that lie in a run of three words which fewer than `SHARED` items have; at
#: least one such run is whole.
LEAST_WORDS, EDITS, FEWEST_EDITS, LEAST_OWN, SHARED = 20, 0.17, 1 / 8, 9, 3

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_MARK = re.compile(r"^[ \t]*(?:(?:[-*+•·>#|]+|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]+)+", re.M)
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n[ \t]*(?:[>|*#]+[ \t]*)?(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words without case, punctuation, markup, list numbers and line layout (hyphens at line ends, hidden characters)."""
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = _HIDDEN.sub("", unicodedata.normalize("NFKC", t))
    if "<" in t:
        t = _TAG.sub(" ", t)
    t = _MARK.sub("", _BREAK.sub("", t))
    return _WORD.findall(t.lower())


def item_words(items: list[tuple[int, str]]) -> dict[tuple[str, ...], list[int]]:
    """The ids of each wording, for copies of an item are one text; items without an id or of fewer than two words are left out."""
    out: dict[tuple[str, ...], list[int]] = {}
    for i, t in items:
        if i is not None and len(w := tuple(words(t))) >= 2:
            ids = out.setdefault(w, [])
            if i not in ids:
                ids.append(i)
    return out


def grams(w: tuple[str, ...] | list[str]) -> tuple[set, set]:
    """The distinct pairs and triples of neighbouring words."""
    return set(zip(w, w[1:])), set(zip(w, w[1:], w[2:]))


class Statistics:
    """What the impacts of an item depend on beside its own words: number and mean length of all texts, in how many each
    pair occurs, and the triples that ``SHARED`` of them have."""

    def __init__(self, n: int, mean: float, pairs: dict, shared: set):
        self.n, self.mean, self.pairs, self.shared = n, mean, pairs, shared

    @classmethod
    def of(cls, texts, shared: int = SHARED) -> "Statistics":
        texts = list(texts)
        pairs, triples = Counter(), Counter()
        for w in texts:
            two, three = grams(w)
            pairs.update(two)
            triples.update(three)
        return cls(len(texts), sum(map(len, texts)) / max(1, len(texts)), pairs, {g for g, n in triples.items() if n >= shared})


class Postings:
    """The postings of a term in order of items: items, impacts, the last item and the greatest impact of each block, the greatest of all."""

    __slots__ = ("items", "impacts", "ends", "tops", "most", "block")

    def __init__(self, postings: list[tuple[int, float]], block: int):
        self.block = block
        self.items, self.impacts = [j for j, _ in postings], [x for _, x in postings]
        self.ends = [self.items[min(a + block, len(postings)) - 1] for a in range(0, len(postings), block)]
        self.tops = [max(self.impacts[a : a + block]) for a in range(0, len(postings), block)]
        self.most = max(self.impacts)

    def __iter__(self):
        return zip(self.items, self.impacts)


class Index:
    """Items as postings of word pairs, with impacts as shares of each item's threshold."""

    def __init__(self, items: list[tuple[int, str]], stats: Statistics | None = None, k1: float = 1.2, b: float = 0.75, block: int = BLOCK):
        texts = sorted(item_words(items).items(), key=lambda x: len(x[0]))
        self.words, self.ids = [w for w, _ in texts], [i for _, i in texts]
        stats = stats or Statistics.of(self.words)
        post: dict[tuple[str, str], list[tuple[int, float]]] = defaultdict(list)
        #: Whether each word of an item lies in a triple that is not shared.
        self.own: list[list[bool]] = []
        #: The triples of an item, those not shared, and how many at least are whole in any leak: an edit breaks three.
        self.runs: list[tuple[set, set, int]] = []
        for j, w in enumerate(self.words):
            own = [False] * len(w)
            for p, g in enumerate(zip(w, w[1:], w[2:])):
                if g not in stats.shared:
                    own[p : p + 3] = [True] * 3
            self.own.append(own)
            triples = [set(zip(w[a : a + LEAST_WORDS], w[a + 1 : a + LEAST_WORDS], w[a + 2 : a + LEAST_WORDS])) for a in range(len(w) - LEAST_WORDS + 1)]
            every = grams(w)[1]
            self.runs.append((every, every - stats.shared, max(1, min(map(len, triples), default=0) - 3 * int(LEAST_WORDS * EDITS))))
            norm, impact = k1 * (1 - b + b * len(w) / stats.mean), {}
            for g, tf in Counter(zip(w, w[1:])).items():
                df = stats.pairs[g]
                impact[g] = math.log((stats.n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + norm)
            least = self.threshold(w, own, impact)
            for g, x in impact.items():
                post[g].append((j, x / least))
        self.post = {g: Postings(p, block) for g, p in post.items()}

    @staticmethod
    def threshold(w: tuple[str, ...], own: list[bool], impact: dict) -> float:
        """The least score of a passage of the item that is a leak: of each stretch with enough own words, all pairs but
        those of the highest impact that the edits allowed can spoil, two for each edit. Infinite if there is none."""
        least, spoilt = math.inf, 2 * math.ceil(LEAST_WORDS * FEWEST_EDITS)
        for a in range(len(w) - LEAST_WORDS + 1):
            if sum(own[a : a + LEAST_WORDS]) >= LEAST_OWN:
                x = sorted(impact[g] for g in set(zip(w[a : a + LEAST_WORDS], w[a + 1 : a + LEAST_WORDS])))
                least = min(least, sum(x[: max(1, len(x) - spoilt)]))
        return least * (1 - 1e-9)

    def search(self, terms, threshold: float = 1.0) -> list[int]:
        """Items whose score is at or above the threshold: all of them, by block-max WAND."""
        lists = [self.post[g] for g in terms if g in self.post]
        if sum(p.most for p in lists) < threshold:
            return []
        found, end = [], len(self.words)
        at = [[p.items[0], 0, p] for p in lists]  # item, position, postings
        slack = threshold * (1 - 1e-12)

        def move(c: list, item: int) -> None:
            """To the first posting at or behind ``item``; blocks that end before it are skipped."""
            p, pos = c[2], c[1]
            blk, size = pos // p.block, len(p.items)
            if p.ends[blk] < item:
                blk = bisect_left(p.ends, item, blk + 1)
                pos = blk * p.block
            c[1] = pos = bisect_left(p.items, item, pos, min(size, (blk + 1) * p.block)) if pos < size else size
            c[0] = p.items[pos] if pos < size else end

        while True:
            at.sort(key=_item)
            bound, pivot = 0.0, -1
            for k, c in enumerate(at):
                if c[0] == end:
                    break
                bound += c[2].most
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            bound, last = 0.0, end
            for c in at[: pivot + 1]:  # the blocks in which the pivot would lie
                p = c[2]
                blk = bisect_left(p.ends, item, c[1] // p.block)
                if blk < len(p.ends):
                    bound += p.tops[blk]
                    last = min(last, p.ends[blk] + 1)
            if bound < slack:  # nothing up to the end of these blocks, or up to where the next cursor stands
                item = min(last, at[pivot + 1][0]) if pivot + 1 < len(at) else last
                for c in at[: pivot + 1]:
                    if c[0] < item:
                        move(c, item)
            elif at[0][0] == item:
                score = sum(c[2].impacts[c[1]] for c in at[: pivot + 1])
                if score >= slack:
                    found.append(item)
                for c in at[: pivot + 1]:
                    move(c, item + 1)
            else:
                for c in at[:pivot]:
                    if c[0] < item:
                        move(c, item)


def _item(cursor: list) -> int:
    return cursor[0]


def align(item, text, gap: int = 2) -> list[tuple[int, int, bool]]:
    """Best local alignment as steps (position in item or -1, position in text or -1, equal); null words equal nothing."""
    n, m = len(item), len(text)
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in item])
    b = np.array([-1 if w is None else codes.setdefault(w, len(codes)) for w in text])
    s = np.zeros((n + 1, m + 1), np.int32)
    ramp = gap * np.arange(m + 1)
    for i in range(1, n + 1):
        v = np.maximum(0, s[i - 1] - gap)
        v[1:] = np.maximum(v[1:], s[i - 1, :-1] + np.where(b == a[i - 1], 1, -gap))
        s[i] = np.maximum.accumulate(v + ramp) - ramp
    i, j = np.unravel_index(int(np.argmax(s)), s.shape)
    path = []
    while i and j and s[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if s[i, j] == s[i - 1, j - 1] + (1 if same else -gap):
            i, j = i - 1, j - 1
            path.append((int(i), int(j), bool(same)))
        elif s[i, j] == s[i - 1, j] - gap:
            i -= 1
            path.append((int(i), -1, False))
        else:
            j -= 1
            path.append((-1, int(j), False))
    return path[::-1]


def extended(path: list[tuple[int, int, bool]], item, text) -> list[tuple[int, int, bool]]:
    """``path`` with what lies beyond an edit at either end: a local alignment drops one or two equal words behind an edit.

    Up to two edits at an end, each the one of replaced, dropped and added that most equal words follow.
    """
    for step in (1, -1):
        for _ in range(2):
            end = path[-1] if step == 1 else path[0]
            best: list[tuple[int, int, bool]] = []
            for di, dj in ((1, 1), (1, 0), (0, 1)):
                i, j = end[0] + di * step, end[1] + dj * step
                more = [(i if di else -1, j if dj else -1, False)]
                i, j = i + step, j + step
                while 0 <= i < len(item) and 0 <= j < len(text) and item[i] == text[j]:
                    more.append((i, j, True))
                    i, j = i + step, j + step
                if len(more) > max(1, len(best)):
                    best = more
            if not best:
                break
            path = path + best if step == 1 else best[::-1] + path
    return path


def longest_run(path: list[tuple[int, int, bool]], edits: float = EDITS) -> tuple[int, int, int]:
    """(words of the item, first step, last step) of the longest stretch that starts and ends with equal words and has at most ``edits`` edits a word."""
    best = (0, 0, -1)
    for x in range(len(path)):
        if not path[x][2] or len(path) - x <= best[0]:
            continue
        wrong = span = 0
        for y in range(x, len(path)):
            i, _, same = path[y]
            wrong += not same
            span += i >= 0
            if same and span > best[0] and wrong <= edits * span:
                best = (span, x, y)
    return best


def verified(index: Index, j: int, part: list[str]) -> int:
    """Words of the longest leak of item ``j`` in a stretch of text, 0 if there is none.

    An alignment with too little own wording is taken out of the text, and the next best one tried, until what is left
    can't score as 20 words with the edits allowed do.
    """
    item, own, part = index.words[j], index.own[j], list(part)
    (runs, own_runs, fewest), edits = index.runs[j], int(LEAST_WORDS * EDITS)
    least = LEAST_WORDS - edits - 2 * edits
    while len(there := runs.intersection(zip(part, part[1:], part[2:]))) >= fewest and not own_runs.isdisjoint(there):
        path = align(item, part)
        if sum(1 if same else -2 for _, _, same in path) < least:
            return 0
        path = extended(path, item, part)
        run, x, y = longest_run(path)
        if run >= LEAST_WORDS and sum(own[i] for i, _, same in path[x : y + 1] if same) >= LEAST_OWN:
            return run
        for _, p, _ in path:
            if p >= 0:
                part[p] = None
    return 0


def leaked(index: Index, text: str | None, window: int = WINDOW, step: int = STEP) -> list[tuple[int, int]]:
    """(item_id, consecutive words) of each item a text leaks."""
    ws = words(text)
    if len(ws) < LEAST_WORDS // 2:
        return []
    post = index.post
    hits = [(p, g) for p, g in enumerate(zip(ws, ws[1:])) if g in post]
    if len(hits) < 5:
        return []
    at = np.array([p for p, _ in hits])
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    starts = np.unique(np.concatenate((at // step, at // step - 1)))
    starts = starts[starts >= 0] * step
    for start, lo, hi in zip(starts.tolist(), np.searchsorted(at, starts).tolist(), np.searchsorted(at, starts + window - 1).tolist()):
        if hi - lo >= 5:
            for j in index.search({hits[k][1] for k in range(lo, hi)}):
                found[j].append((start, start + window))
    out = []
    for j, spots in found.items():
        item, best = index.words[j], 0
        reach = len(item) + 16
        merged: list[list[int]] = []
        for a, b in spots:  # passages that follow one another are verified together
            if merged and a - reach <= merged[-1][1]:
                merged[-1][1] = b + reach
            else:
                merged.append([max(0, a - reach), b + reach])
        for a, b in merged:
            part = ws[a:b]
            # A very long stretch is verified in overlapping pieces of bounded length.
            for c in range(0, max(1, len(part) - 2 * reach), 2048):
                best = max(best, verified(index, j, part[c : c + 2048 + 2 * reach]))
        if best:
            out += [(i, best) for i in index.ids[j]]
    return out


def _global_statistics(items: DataFrame, part: DataFrame, ws: Workspace) -> Statistics:
    """The statistics of all ``items`` that the index of a ``part`` of them needs; counted by the cluster."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                w = words(t)
                if len(w) >= 2:
                    rows += [("\x1f".join(w), g) for kind in grams(w) for g in map("\x1f".join, kind)]
            yield pd.DataFrame(rows, columns=["text", "gram"])

    schema = "text string, gram string"
    every = ws.put("grams", items.select("text").mapInPandas(explode, schema).withColumn("text", F.unhex(F.md5("text"))).distinct())
    counts = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    mine = part.select("text").mapInPandas(explode, schema).select("gram").distinct()
    rows = [(tuple(r["gram"].split("\x1f")), r["n"]) for r in mine.join(counts, "gram").collect()]  # as many as the part has
    lengths = items.select("text").mapInPandas(lambda b: (pd.DataFrame({"text": ["\x1f".join(w) for w in map(words, pdf["text"]) if len(w) >= 2]}) for pdf in b), "text string").distinct()
    n, total = lengths.agg(F.count(F.lit(1)), F.sum(F.size(F.split("text", "\x1f")))).first()
    return Statistics(n, (total or 0) / max(1, n), {g: k for g, k in rows if len(g) == 2}, {g for g, k in rows if len(g) == 3 and k >= SHARED})


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words): each text with each item it leaks and the longest run of the item's words.

    The items are a fixed benchmark, small by nature; their number and length are checked, and a larger set is searched
    in parts, each with its own index but with the counts of all items, so that parts find what the whole would. Null
    and empty texts or items leak nothing, repeated items are one, copies under several ids leak together. Every text
    is searched whole.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").dropDuplicates(["item_id", "text"])
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // MOST_ITEMS), -(-chars // MOST_CHARS))
    ws = Workspace(spark, "leaks") if parts > 1 else None
    out = None
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) if parts > 1 else items
        stats = _global_statistics(items, rows, ws) if parts > 1 else None
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows.orderBy("item_id", "text").collect()], stats))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ix = index.value
            for pdf in batches:
                got = [(d, i, k) for d, t in zip(pdf["i"], pdf["t"]) for i, k in leaked(ix, t)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "n_words"])

        part = spread(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))).mapInPandas(search, "doc_id bigint, item_id bigint, n_words bigint")
        out = part if out is None else out.unionByName(part)
    return out


def exact_runs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each text that has 20 consecutive words of an item as they are, by built-in functions: a
    lower bound of what must be found. Words are runs of ASCII letters and digits; at least ``LEAST_OWN`` of the
    passage's triples are in fewer than ``SHARED`` items."""

    def tokens(df: DataFrame, key: str) -> DataFrame:
        return df.filter("text is not null").select(key, F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")).alias("w"))

    def windows(size: int):
        return F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda p: F.struct(p.alias("p"), F.xxhash64(F.slice("w", p, F.lit(size))).alias("g")))

    it = tokens(items, "item_id").filter(F.size("w") >= LEAST_WORDS)
    triples = it.select("item_id", F.inline(windows(3)))
    counts = triples.groupBy("g").agg(F.countDistinct("item_id").alias("n"))
    ahead = Window.partitionBy("item_id").orderBy("p").rowsBetween(0, LEAST_WORDS - 3)
    own = triples.join(counts, "g").select("item_id", "p", F.sum((F.col("n") < SHARED).cast("int")).over(ahead).alias("k")).filter(F.col("k") >= LEAST_OWN)
    passages = it.select("item_id", F.inline(windows(LEAST_WORDS))).join(own, ["item_id", "p"], "left_semi").select("item_id", "g").distinct()
    texts = tokens(docs, "doc_id").filter(F.size("w") >= LEAST_WORDS).select("doc_id", F.explode(F.transform(windows(LEAST_WORDS), lambda x: x["g"])).alias("g"))
    return texts.join(passages, "g").select("doc_id", "item_id").distinct()
