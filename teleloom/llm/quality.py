"""Per-document text statistics, and whether a text is running prose.

A text is cut into units: runs of neighbouring lines of one kind inside a paragraph. A unit is described by two
distributions, of its tokens (the function words of its best language by their grammatical classes, other words,
names, numbers, mixed tokens, sentence marks, symbols) and of its characters over character classes, and compared by
Jensen-Shannon divergence with structural profiles. The nearest profile names the unit's structure; a text is prose if
at least half of its characters lie in units whose profile is prose.

The profiles come from a bounded sample of labelled documents (``fit_profiles``): each language starts with the
profile of its prose, other units of similar distributions are gathered into further profiles, and a profile is prose
if most of its characters come from documents labelled prose. Labels of single annotators may be wrong; profiles
average over them.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.plans.storage import spread

#: Common function words by language, and by class in the order of CLASSES.
CLASSES = ("determiner", "preposition", "conjunction", "pronoun", "auxiliary", "adverb")
FUNCTION_WORDS = {
    "en": ("the a an this that these all each any some such both no what which",
           "of to in for on with by at from over after before into during about than",
           "and or but as if when while because until since though although whether nor yet then where how so",
           "it we their them they he she his her my me our your you its who",
           "is was are be have had were can do will would has could been did get may should does must",
           "not there now only also once again"),
    "de": ("der die das den des dem ein eine einer einem einen diese dieser dieses",
           "in von zu mit auf für im an aus nach bei um am über zum vor zur bis durch ohne seit",
           "und als dass wie oder aber wenn weil sodass obwohl",
           "sich es er sie man niemand wir ihr ich was",
           "ist werden hat wird sind war haben sein wurde kann hatte hätte wäre",
           "nicht auch noch so nur mehr doch immer kaum"),
    "fr": ("le la les des du un une ce cette ces son sa ses leur tout",
           "de en dans pour sur au aux par avec sans après avant jusqu pendant depuis",
           "et que mais ou comme si parce lorsque puis",
           "qui il elle on nous vous ils se personne même",
           "est sont été être a ont avait",
           "pas plus ne bien encore toujours aussi très peine"),
    "es": ("el la los las un una su sus este esta estos estas todo todos uno otros ese",
           "de del en por con para al sin sobre hasta desde durante contra entre tras según",
           "y que como pero o porque cuando donde ni aunque mientras",
           "se lo le me quien nos eso nadie",
           "es hay había ha han fue era",
           "no más ya muy también siempre apenas así"),
}
_LANGS = tuple(FUNCTION_WORDS)
_CLASS_OF = [{w: c for c, words in enumerate(classes) for w in words.split()} for classes in FUNCTION_WORDS.values()]
KINDS = (*CLASSES, "word", "name", "caps", "number", "mixed", "mark", "symbol")
WORD, NAME, CAPS, NUMBER, MIXED, MARK, SYMBOL = range(len(CLASSES), len(KINDS))
CHARS = ("lower", "upper", "digit", "space", "mark", "symbol", "foreign")
_TOKEN = re.compile(r"[^\s.,;:!?\"'“”„«»’()…]+(?:['’][^\W\d_]+)*|[.,;:!?\"“”„«»()…]")
_MARKS = frozenset(".,;:!?\"'“”„«»’()…-–—")
_ALPHA = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\Z")
_NUM = re.compile(r"[+\-−]?\d[\d.,:%]*[a-z]{0,2}\Z")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
SHORT = 6  # a line of fewer tokens takes the kind of its neighbours


_SEEN: dict[str, tuple[int, int, tuple]] = {}  # token -> (kind, length if it is a word, (language, class) of each language it is a function word of)


def _classify(t: str) -> tuple[int, int, tuple]:
    kind, function = WORD, ()
    if len(t) == 1 and t in _MARKS:
        kind = MARK
    elif _ALPHA.match(t):
        parts = [p for p in re.split("['’]", t.lower()) if p]
        hits = [(i, next((known[p] for p in parts if p in known), None)) for i, known in enumerate(_CLASS_OF)]
        function = tuple((i, c) for i, c in hits if c is not None)
        if len(t) > 24:
            kind = MIXED
        elif t.isupper() and len(t) > 1:
            kind = CAPS
        elif t[0].isupper():
            kind = NAME if len(t) == 1 or t[1:].islower() else MIXED
        else:
            kind = WORD if t.islower() else MIXED
    elif _NUM.match(t):
        kind = NUMBER
    else:
        kind = MIXED if any(c.isalnum() for c in t) else SYMBOL
    if len(_SEEN) > 200_000:
        _SEEN.clear()
    _SEEN[t] = out = kind, len(t) if kind < MARK else 0, function
    return out


class _CharClasses(dict):
    """Code point -> letter of its class, in the order of CHARS."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        near = c.isascii() or c in "äöüßéèêàâçùûîïôëñíóúáœæÄÖÜÉÈÀÇÑÍÓÚÁ"
        if c.islower() or c.isupper():
            out = ("a" if c.islower() else "b") if near else "g"
        else:
            out = "c" if c.isdigit() else "d" if c.isspace() else "e" if c in _MARKS else "g" if c.isalpha() else "f"
        self[code] = out
        return out


_CLASS = _CharClasses()


def token_counts(text: str) -> tuple[list[int], str]:
    """Counts over KINDS + CHARS and the length of all words (unnormalised), and the language of most function words."""
    kinds, length, function, seen = [0] * len(KINDS), 0, [], _SEEN.get
    for t in _TOKEN.findall(text):
        kind, n, more = seen(t) or _classify(t)
        kinds[kind] += 1
        length += n
        if more:
            function += more
    lang = ""
    if function:
        hits = [0] * len(_LANGS)
        for i, _ in function:
            hits[i] += 1
        top = max(hits)
        best = hits.index(top)
        lang = _LANGS[best]
        # Function words of the best language are kinds of their own; they were counted as words or names above.
        for i, c in function:
            if i == best:
                kinds[c] += 1
        moved = min(top, kinds[WORD])
        kinds[WORD], kinds[NAME] = kinds[WORD] - moved, max(0, kinds[NAME] - (top - moved))
    count = text.translate(_CLASS).count
    return [*kinds, count("a"), count("b"), count("c"), count("d"), count("e"), count("f"), count("g"), length], lang


def token_vector(text: str) -> tuple[np.ndarray, str]:
    """``token_counts`` as an array."""
    v, lang = token_counts(text)
    return np.array(v, float), lang


def distribution(v: np.ndarray) -> np.ndarray:
    """The two distributions side by side, lightly smoothed."""
    a, b = v[: len(KINDS)] + 0.05, v[len(KINDS) : len(KINDS) + len(CHARS)] + 0.5
    return np.concatenate((a / a.sum(), b / b.sum()))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``q`` from ``p``: word kinds weigh two thirds, characters one."""
    m = (p + q) / 2
    d = 0.5 * (p * np.log2(p / m) + q * np.log2(q / m))
    k = len(KINDS)
    return (2 * d[..., :k].sum(-1) + d[..., k:].sum(-1)) / 3


def visible(text: str) -> str:
    """The text without soft hyphens and zero-width characters."""
    return text if text.isascii() else _HIDDEN.sub("", text)


_WEIGHTS = np.repeat(np.array([2 / 3, 1 / 3], np.float32), [len(KINDS), len(CHARS)])


def _entropies(p: np.ndarray) -> np.ndarray:
    """Entropies (in nats) of rows of two distributions side by side, weighed as in ``divergence``."""
    return -(p * np.log(p)) @ _WEIGHTS


def paragraphs(text: str) -> list[list[str]]:
    """Lines of each paragraph; blank lines divide."""
    out: list[list[str]] = [[]]
    for line in text.splitlines():
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


class Profiles:
    """Structural profiles: names, distributions, and which are prose."""

    def __init__(self, names: list[str], rows: np.ndarray, prose: np.ndarray):
        self.names, self.rows, self.prose = names, np.asarray(rows, float), np.asarray(prose, bool)
        self._entropy: np.ndarray | None = None

    def nearest(self, vs: np.ndarray) -> np.ndarray:
        """The nearest profile of each row of counts; the entropies of the profiles are computed once."""
        if self._entropy is None:
            self._halves = (self.rows / 2).astype(np.float32)
            self._entropy = _entropies(self.rows.astype(np.float32))
        x = np.asarray(vs, np.float32)
        a, b = x[:, : len(KINDS)] + np.float32(0.05), x[:, len(KINDS) : len(KINDS) + len(CHARS)] + np.float32(0.5)
        p = np.concatenate((a / (2 * a.sum(1, keepdims=True)), b / (2 * b.sum(1, keepdims=True))), axis=1)
        m = p[:, None, :] + self._halves[None, :, :]
        return np.argmin(2 * _entropies(m) - self._entropy[None, :], axis=1)  # the own entropy is the same for all profiles

    def dump(self) -> str:
        return json.dumps([self.names, self.rows.round(6).tolist(), self.prose.tolist()])

    @classmethod
    def load(cls, text: str) -> "Profiles":
        return cls(*json.loads(text))

    def units(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """(characters, profile) of each unit of a whole text, blank lines left out, and the counts of all lines together."""
        parts = paragraphs(visible(text))
        flat = [x for lines in parts for x in lines]
        if not flat:
            return [], token_vector("")[0]
        vs = np.array([token_counts(x)[0] for x in flat], float)
        long = vs[:, : len(KINDS)].sum(1) >= SHORT
        prose = self.prose[self.nearest(vs)].tolist()
        runs, at = [], 0
        for lines in parts:
            n = len(lines)
            kinds = [prose[at + i] if long[at + i] else None for i in range(n)]
            if n > 1 and any(k is not None for k in kinds):
                last = next(k for k in kinds if k is not None)
                for i, k in enumerate(kinds):  # short lines follow the line before
                    last = kinds[i] = last if k is None else k
                for i in range(1, n - 1):  # a lone line between two of the other kind follows them
                    if kinds[i - 1] == kinds[i + 1] != kinds[i]:
                        kinds[i] = kinds[i - 1]
            else:
                kinds = [None] * n
            a = 0
            for b in range(1, n + 1):
                if b == n or kinds[b] != kinds[a]:
                    runs.append((at + a, at + b))
                    a = b
            at += n
        sums = np.add.reduceat(vs, [a for a, _ in runs], axis=0)
        return [(sum(map(len, flat[a:b])) + b - a - 1, int(i)) for (a, b), i in zip(runs, self.nearest(sums))], vs.sum(0)


def learn(texts: list[tuple[str, bool]], most: int = 32, spread: float = 0.035) -> Profiles:
    """Profiles of the units of labelled texts.

    Leaders are the prose of each language and then, farthest first, further units until every one lies within
    ``spread`` of a leader or there are ``most``; then some rounds of nearest-leader averages.
    """
    vs, prose, weight, langs = [], [], [], []
    for text, label in texts:
        for lines in paragraphs(visible(text or "")):
            v, lang = token_vector("\n".join(lines))
            if v[: len(KINDS)].sum() >= SHORT:
                vs.append(distribution(v))
                prose.append(label)
                weight.append(sum(map(len, lines)))
                langs.append(lang)
    if not vs:
        raise ValueError("no labelled text to learn from")
    x, y, w = np.array(vs), np.array(prose, float), np.array(weight, float)
    at = np.array(langs)
    rows = [np.average(x[of], axis=0, weights=w[of]) for lang in _LANGS if (of := (at == lang) & (y > 0)).any()]  # the prose of each language
    rows = rows or [x[int(np.argmin(divergence(x, x.mean(0)[None, :])))]]
    d = np.min([divergence(x, r[None, :]) for r in rows], axis=0)
    while len(rows) < most and d.max() > spread:
        rows.append(x[int(np.argmax(d))])
        d = np.minimum(d, divergence(x, rows[-1][None, :]))
    rows = np.array(rows)
    for _ in range(10):
        who = np.argmin(np.stack([divergence(x, r[None, :]) for r in rows]), axis=0)
        new = np.array([np.average(x[who == i], axis=0, weights=w[who == i]) if (who == i).any() else rows[i] for i in range(len(rows))])
        if np.allclose(new, rows):
            break
        rows = new
    share = np.array([np.average(y[who == i], weights=w[who == i]) if (who == i).any() else 0.0 for i in range(len(rows))])
    names = []
    for i, r in enumerate(rows):
        lang = Counter(np.array(langs)[who == i].tolist()).most_common(1)
        kind = KINDS[int(np.argmax(r[: len(KINDS)]))]
        names.append(f"prose-{lang[0][0]}-{i}" if share[i] >= 0.5 and lang else f"{kind}-{i}")
    return Profiles(names, rows, share >= 0.5)


def _default() -> Profiles:
    """Profiles to start from where there are no labels of both kinds: prose by its function words, against nine kinds of other text."""
    classes = np.array([30, 25, 13, 12, 14, 6]) / 100  # of a hundred function words of prose
    kinds = [("prose", [43, 40, 6, 0, 3, 0, 8, 0], [76, 2, 2, 18, 2, 0, 0]), ("prose-short", [25, 48, 8, 0, 6, 0, 13, 0], [74, 2, 3, 18, 3, 0, 0])]
    kinds += [("words", [1, 80, 5, 0, 0, 0, 14, 0], [84, 1, 0, 13, 2, 0, 0]), ("list", [1, 55, 2, 0, 2, 10, 0, 30], [75, 1, 1, 18, 3, 2, 0]), ("log", [5, 25, 0, 7, 24, 18, 21, 0], [40, 8, 29, 11, 9, 3, 0])]
    kinds += [("table", [0, 15, 0, 0, 20, 10, 5, 50], [35, 0, 20, 28, 5, 12, 0]), ("code", [0, 2, 0, 0, 0, 96, 2, 0], [40, 35, 15, 2, 3, 5, 0]), ("keys", [0, 33, 0, 0, 4, 30, 33, 0], [76, 0, 7, 6, 6, 5, 0]), ("fields", [0, 12, 0, 0, 18, 35, 35, 0], [50, 0, 10, 16, 24, 0, 0])]
    kinds += [("menu", [5, 0, 47, 0, 0, 0, 0, 48], [54, 12, 0, 22, 0, 12, 0]), ("noise", [0, 2, 0, 0, 1, 88, 0, 9], [15, 0, 5, 5, 0, 60, 15])]
    return Profiles([k for k, _, _ in kinds], np.array([distribution(np.array([*(a[0] * classes), *a[1:], *b], float)) for _, a, b in kinds]), [k.startswith("prose") for k, _, _ in kinds])


def fit_profiles(docs: DataFrame, labels: DataFrame, most_docs: int = 4000, longest: int = 8000) -> Profiles:
    """Profiles from a bounded sample of labelled documents.

    A document's label is that of most of its annotators (repeated rows count once; ties are left out). At most
    ``most_docs`` documents, those of the smallest hash of their id, none of more than ``longest`` characters, reach
    the driver. Without labels of both kinds the profiles are fixed ones.
    """
    votes = labels.filter("doc_id is not null and label in ('prose', 'other')").dropDuplicates(["doc_id", "annotator", "label"])
    each = votes.groupBy("doc_id").agg(F.sum(F.when(F.col("label") == "prose", 1).otherwise(-1)).alias("v")).filter("v <> 0")
    some = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").filter(F.length("text") <= longest).select("text", (F.col("v") > 0).alias("y")).limit(most_docs).collect()
    texts = [(r["text"], r["y"]) for r in rows if r["text"] and r["text"].strip()]
    return learn(sorted(texts)) if len({y for _, y in texts}) == 2 else _default()


STATS = "n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, upper_ratio double, line_end_share double, bullet_share double, common_word_share double, repeated_line_share double, prose_share double, structure string, divergence double, is_prose boolean"


def statistics_of(text: str | None, profiles: Profiles) -> tuple:
    """The row of STATS of one text; null and blank texts have zero counts, null ratios and are not prose."""
    if text is None or not text.strip():
        return (len(text or ""), 0, 0, *[None] * 8, 0.0, "blank", None, False)
    units, v = profiles.units(text)
    total = sum(n for n, _ in units)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    words = int(v[:MARK].sum())
    upper, digit, space, symbol = v[len(KINDS) + 1], v[len(KINDS) + 2], v[len(KINDS) + 3], v[len(KINDS) + 5]
    ink = max(1.0, v[len(KINDS) : -1].sum() - space)
    sizes: dict[int, int] = {}
    for n, i in units:
        sizes[i] = sizes.get(i, 0) + n
    main = max(sizes, key=lambda i: (sizes[i], -i)) if sizes else int(profiles.nearest(v[None, :])[0])
    share = sum(n for i, n in sizes.items() if profiles.prose[i]) / max(1, total)
    return (len(text), words, len(lines), float(v[-1] / words) if words else None, float(symbol / ink), float(digit / ink), float(upper / ink),
        sum(x[-1] in ".!?:;…" for x in lines) / max(1, len(lines)), sum(x[0] in "-*+•·>|#" for x in lines) / max(1, len(lines)),
        float(v[:WORD].sum() / max(1, words)), 1 - len(set(lines)) / max(1, len(lines)), float(share), profiles.names[main], float(divergence(distribution(v)[None, :], profiles.rows[main][None, :])[0]), bool(share >= 0.5))


def statistics(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id and STATS for each row of ``docs`` (doc_id, text), over whole texts; repeated rows stay."""
    packed, names = profiles.dump(), [x.split()[0] for x in STATS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Profiles.load(packed)
        for pdf in batches:
            out = pd.DataFrame([statistics_of(t if isinstance(t, str) else None, p) for t in pdf["t"]], columns=names)
            out.insert(0, "doc_id", pdf["i"].to_numpy())
            yield out

    return spread(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))).mapInPandas(run, f"doc_id bigint, {STATS}")


def counts(docs: DataFrame) -> DataFrame:
    """Plain counts by built-in functions: doc_id, n_chars, n_words (runs of non-blanks), n_lines, n_word_chars; null texts count as empty."""
    t = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(t, r"[ \t\n\r]+", "")
    squeezed = F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))
    gaps = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return docs.select("doc_id", F.length(t).cast("bigint").alias("n_chars"), F.when(squeezed == "", 0).otherwise(gaps + 1).cast("bigint").alias("n_words"),
        F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"), F.length(bare).cast("bigint").alias("n_word_chars"))
