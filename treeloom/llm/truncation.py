"""Texts that stop before their author ended them.

Two kinds of evidence meet. *Alignment*: near-copies are found by min-hash banding
over five-word shingles, of whole texts and of their beginnings, so that a copy
that lost most of its text meets the whole one too. They are aligned and verified
at a Jaccard similarity of 0.8 or more, of the texts or of the shorter one with as
much of the longer; a copy whose alignment ends inside a sentence that the other
copy goes on with is cut, one that ends where the sentence does is not.
*Terminality*: a text without a longer copy is judged by how it ends. An open
block of code, tag, bracket or half an escape shows a cut at once, a sentence mark
shows an end. A bare ending is scored by counts over all documents: how often its
closing word closes units of its kind, and how often units with its opening words
end bare. Each text is read once, for the counts, its ending and its band keys.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.runtime import materialize

#: What sites put in place of a missing rest, and marks that end a sentence.
MARKERS = ("…", "[...]", "[…]", "(...)", "(…)", "[sigue]", "(leer más)", "(sigue)", "[más]", "[more]", "(more)", "[continued]", "(continued)", "(read more)", "read more", "[weiter]", "(weiterlesen)", "[suite]", "(lire la suite)", "[truncated]", "[cut]", "<truncated>")
SENTENCE_END = ".?!。！？"
_ENDS = frozenset(SENTENCE_END)

_MARKERS = tuple(sorted(MARKERS, key=len, reverse=True))
_CLOSERS = "\"'”’»)]*_"
_SPLIT = re.compile(r"""(?<=[.?!。！？])["'”’»)\]]*\s+""")
_LIST = re.compile(r"^\s*(?:\d+[.)]|[-*+•])\s+")
_SMILE = re.compile(r"(?:[:;=]-?[)(DPp]|<3)$")
_URL = re.compile(r"(?:https?|ftp)://\S*$")
_ENTITY = re.compile(r"&(?:#?\w{0,9})$")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$")
_TAGS = re.compile(r"<(/?)(pre|code|a|b|i|em|strong|blockquote|p|div|span|ul|ol|li)\b[^<>]*>", re.IGNORECASE)
_OPEN_TAG = re.compile(r"<[/a-zA-Z][^<>]*$")
# one that began far back must read as a tag with attributes throughout, as prose and code also hold a lone <
_LONG_TAG = re.compile(r"""<[a-zA-Z][\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))*\s*(?:[\w:@.-]+\s*(?:=\s*(?:"[^"]*|'[^']*)?)?)?$""")
_INDENTED = re.compile(r"^(?: {4}|\t)\S")
_DIGITS = re.compile(r"\d")
_LAST_WORD = re.compile(r"\w+\W*$")
_QUOTED = re.compile(r"^[>\s]+")


class _Kept(dict):
    """A function's values by word, a bounded number of them: looked up much faster than in an lru_cache."""

    def __init__(self, function, most: int = 200_000):
        self.function, self.most = function, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.function(word)
        return value


_KEYS = _Kept(lambda word: _DIGITS.sub("0", word.lower()))
_key = _KEYS.__getitem__


def strip_marker(text: str) -> tuple[str, bool]:
    """The text before trailing stand-ins for a missing rest, and whether there were any."""
    text = cut = text.rstrip()
    while (tail := cut[-len(_MARKERS[0]) :].lower()).endswith(_MARKERS):
        cut = cut[: -len(next(m for m in _MARKERS if tail.endswith(m)))].rstrip()
    return cut, cut != text


def _open_bracket(line: str) -> bool:
    line = re.sub(r"[:;=]-?[()DPp]", "", line)
    depth: list[str] = []
    for c in line:
        if c in "([{":
            depth.append(c)
        elif c in ")]}" and depth:
            depth.pop()
    return bool(depth)


def _url_key(url: str) -> str:
    body = url.split("://", 1)[1]
    host, slash, path = body.partition("/")
    if not slash:
        return "host only"
    last = path.rsplit("/", 1)[-1]
    return "end " + ("0" * len(last) if last.isdigit() else last.lower())


def _ended(piece: str) -> bool:
    """Whether a sentence mark ends the text, quotes and brackets after it aside."""
    return piece.rstrip(_CLOSERS)[-1:] in _ENDS


def _url_at_end(piece: str) -> re.Match | None:
    return _URL.search(piece) if "://" in piece else None


def _close_of(piece: str) -> str:
    if _url_at_end(piece):
        return "bare"
    return "dots" if piece.endswith("...") and piece[-4:-3] != "." else "mark" if _ended(piece) else "bare"


class Unit:
    """A sentence or other closed piece: kind, opening words, last word, and how it closes."""

    __slots__ = ("kind", "open2", "open1", "close", "close2", "form", "end", "inline")

    def __init__(self, kind: str, text: str, end: str, inline: bool = False):
        words = text.split()
        self.kind, self.end, self.inline = kind, end, inline
        self.open1 = _key(words[0]) if words else ""
        self.close = _key(words[-1]) if words else ""
        self.open2 = f"{self.open1} {_key(words[1])}" if len(words) > 1 else ""
        self.close2 = f"{_key(words[-2])} {self.close}" if len(words) > 1 else self.close
        self.form = f"{len(words)} {self.open1}" if kind == "text" else str(len(words))


def read_units(text: str) -> tuple[list[Unit], str]:
    """Units of a text in order, and a verdict on its ending: cut, closed or bare.

    Only a bare ending needs scores; the last unit is then what it ends with.
    """
    body, marked = strip_marker(text)
    lines = body.replace("\r\n", "\n").split("\n")
    units: list[Unit] = []
    fenced = False
    block: list[str] = []

    def close_block() -> None:
        if block:
            for i, b in enumerate(block):
                word = (_LAST_WORD.findall(b.strip()) or [b.strip()])[-1]
                units.append(Unit("code", word, "bare" if i == len(block) - 1 else "open"))
            block.clear()

    for line in lines:
        if line.lstrip().startswith("```"):
            close_block()
            fenced = not fenced or line.strip() != "```" and line.count("```") % 2 == 0 and not fenced
            if line.strip().count("```") == 2:
                fenced = False
            continue
        if fenced:
            continue
        if _INDENTED.match(line) and not _LIST.match(line):
            block.append(line)
            continue
        if not line.strip():
            continue
        close_block()
        if _LIST.match(line):
            units.append(Unit("list", _LIST.sub("", line), "mark" if _ended(line.rstrip()) else "bare"))
            continue
        for n, piece in enumerate(_SPLIT.split(_QUOTED.sub("", line.rstrip()))):
            if piece.strip():
                url = _url_at_end(piece)
                units.append(Unit("url" if url else "text", piece, _close_of(piece), n > 0))
                if url:
                    units[-1].close = _url_key(url[0])
    close_block()
    tail = lines[-1] if lines else ""
    bare_tail = tail.rstrip()
    opened = 0
    for m in _TAGS.finditer(body):
        if m[2].lower() in ("pre", "code", "a", "blockquote"):
            opened += -1 if m[1] else 1
    if fenced or bare_tail.endswith(("�", "``")) and not bare_tail.endswith("```") or bare_tail == "`":
        return units, "cut"
    at = body.rfind("<")
    unfinished = at >= 0 and (_OPEN_TAG if len(body) - at <= 300 else _LONG_TAG).match(body, at)
    if opened > 0 or unfinished or bare_tail.endswith("<"):
        return units, "cut"
    if _ESCAPE.search(bare_tail) or _ENTITY.search(bare_tail):
        return units, "cut"
    ended = _ended(bare_tail) and not _url_at_end(bare_tail)
    if marked:
        # a stand-in after an ended sentence is an omission the author made
        return units, "closed" if ended or not bare_tail else "cut"
    if not units:
        return units, "closed"
    if units[-1].kind == "code" and tail.startswith((" ", "\t")):
        return units, "cut" if _open_bracket(bare_tail) or bare_tail.count('"') % 2 else "bare"
    if tail.lstrip().startswith("```") or re.search(r"</(?:pre|code|a|p|div|blockquote)>$", bare_tail) or _SMILE.search(bare_tail):
        return units, "closed"
    if _open_bracket(tail) or bare_tail.count("`") % 2:
        return units, "cut"
    if units[-1].end == "dots":
        return units, "bare"
    if ended:
        return units, "closed"
    if bare_tail[-1] in ",;(–—-/:&=" and len(bare_tail) > 3:
        return units, "cut"
    if re.search(r"\]\(\S+\)$", bare_tail) or bare_tail.endswith("`"):
        return units, "closed"
    return units, "bare"


def _count_units(units: list[Unit], times: int, n: Counter, hits: Counter) -> None:
    """Counts of a text's units. Its last one counts like any other, links apart: a text's own part is taken off again when it is scored."""
    for i, u in enumerate(units):
        # how links end is learned from those with something after them: last ones are cut too often
        if u.kind == "url" and i == len(units) - 1:
            continue
        for stat, key, hit in _stats(u, u.end == "bare"):
            n[stat, key] += times
            hits[stat, key] += hit * times


def _stats(u: Unit, bare: bool) -> Iterator[tuple[str, str, int]]:
    if u.kind == "code":
        yield "close code", u.close, int(bare)
    elif u.kind == "url":
        yield "close url", u.close, 1
        yield "url", "", 1
    elif u.kind == "list":
        yield "list", "", 1
        yield "form list", u.form, 1
        yield "tail list", u.close2, 1
    else:
        if u.open2:
            yield "open2", u.open2, int(bare)
            yield "dots2", u.open2, int(u.end == "dots")
        yield "open1", u.open1, int(bare)
        yield "dots1", u.open1, int(u.end == "dots")
        if bare:
            yield "bare1", u.open1, 1
            yield "form bare", u.form, 1


def _count_words(text: str, times: int, n: Counter, hits: Counter, written: Counter, once: dict[str, list]) -> None:
    """How often each word stands anywhere, and how often a word or two words standing in a bare unit close it.

    What counts once is put into ``once``, by what it counts as, to be counted with that of other texts.
    """
    body, _ = strip_marker(text)
    if times == 1:
        once["word"] += body.split()
    else:
        for w in body.split():
            written[w] += times
    for line in body.split("\n"):
        if "```" in line or _INDENTED.match(line):
            continue
        listed = bool(_LIST.match(line))
        for piece in _SPLIT.split(_LIST.sub("", line.rstrip()) if listed else line.rstrip()):
            if not piece.strip() or not listed and _close_of(piece) != "bare":
                continue
            stat, pair = ("in list", "pair list") if listed else ("in bare", "pair bare")
            ws = [*map(_key, piece.split())]
            both = [*map(" ".join, zip(ws, ws[1:]))]
            if times == 1:
                once[stat] += ws
                once[pair] += both
            else:
                for w in ws:
                    n[stat, w] += times
                for w in both:
                    n[pair, w] += times
            hits[stat, ws[-1]] += times
            if both:
                hits[pair, both[-1]] += times


def _bare_word(word: str) -> str:
    return _key(word.strip(SENTENCE_END + ",;:()[]\"'`"))


def _needs(text: str, u: Unit) -> tuple[str, list[tuple[str, str]]]:
    """Kind of a bare ending and the counts it is scored by."""
    if u.kind == "code":
        need = [("close code", u.close)]
    elif u.kind == "url":
        need = [("close url", u.close), ("url", "")]
    elif u.kind == "list":
        need = [("in list", u.close), ("pair list", u.close2), ("form list", u.form), ("list", "")]
    elif u.end == "dots":
        need = [("dots2", u.open2), ("dots1", u.open1)]
    else:
        need = [("open2", u.open2), ("open1", u.open1), ("in bare", u.close), ("pair bare", u.close2), ("form bare", u.form), ("bare1", u.open1)]
    word = _bare_word(text.split()[-1])
    need += [("word", word), ("longer word", word)]
    if u.kind == "list":
        need += [("longer in list", u.close)]
    return "dots" if u.end == "dots" else "inline" if u.inline and u.kind == "text" else u.kind, need


#: What is read from texts: tag "count" has stat, key, n and hits; "ending" rep, verdict, kind, stat and key, the counts
#: it needs or null; "band" rep, n (characters), hits (1 if a longer copy is looked for) and band.
FACTS = "tag string, rep bigint, stat string, key string, n bigint, hits bigint, verdict string, kind string, band bigint"
_FACTS = pa.schema([("rep", pa.int64()), ("stat", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("hits", pa.int64()), ("verdict", pa.string()), ("kind", pa.string()), ("band", pa.int64())])


def _facts(tag: str, **columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _FACTS]
    return pa.RecordBatch.from_arrays([pa.array([tag] * size), *arrays], names=["tag", *_FACTS.names])


def _reader(bands: int, rows: int, size: int):
    """Everything that is wanted of texts(rep, text, times), each read once; counts are added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits, written = Counter(), Counter(), Counter()
        singly = {stat: Counter() for stat in ("in bare", "pair bare", "in list", "pair list")}

        def add_up(once: dict[str, list]) -> None:
            for stat, keys in once.items():
                (written if stat == "word" else singly[stat]).update(keys)
                keys.clear()

        def counts() -> Iterator[pa.RecordBatch]:
            for stat, counter in singly.items():
                for key, count in counter.items():
                    n[stat, key] += count
            for w, count in written.items():  # each different word is normalised once
                n["word", _bare_word(w)] += count
            if n:
                yield _facts("count", stat=[k[0] for k in n], key=[k[1] for k in n], n=list(n.values()), hits=[hits[k] for k in n])
            for c in (n, hits, written, *singly.values()):
                c.clear()

        for batch in batches:
            reps, texts = batch.column("rep").to_pylist(), batch.column("text").to_pylist()
            endings, asks = [], []
            once = {"word": [], **{stat: [] for stat in singly}}
            for rep, text, times in zip(reps, texts, batch.column("times").to_pylist()):
                units, verdict = read_units(text)
                _count_units(units, times, n, hits)
                _count_words(text, times, n, hits, written, once)
                if len(once["word"]) > 100_000:
                    add_up(once)
                asks.append(verdict != "closed")
                if verdict == "bare":
                    kind, need = _needs(text, units[-1])
                    endings.extend((rep, verdict, kind, s, k) for s, k in need)
                else:
                    endings.append((rep, verdict, "", None, None))
            add_up(once)
            if endings:
                yield _facts("ending", **dict(zip(("rep", "verdict", "kind", "stat", "key"), zip(*endings))))
            for at in range(0, len(texts), 500):  # few enough for a processor's own memory
                bodies = [strip_marker(t)[0] for t in texts[at : at + 500]]
                of, keys, asking = band_rows(bodies, np.array(asks[at : at + 500]), bands, rows, size)
                if len(of):
                    yield _facts("band", rep=np.array(reps[at : at + 500])[of], n=np.fromiter(map(len, bodies), np.int64, len(bodies))[of], hits=asking.astype(np.int64), band=keys)
            if len(n) + len(written) + sum(map(len, singly.values())) > 300_000:
                yield from counts()
        yield from counts()

    return run


def corpus_counts(facts: DataFrame, chars: int = 64) -> DataFrame:
    """(stat, key, n, hits) over all texts; "longer ..": how often words occur that go on after the key.

    Keys of up to ``chars`` characters meet longer words by their prefixes, and
    longer keys those that begin with the same ``chars`` characters.
    """
    total = materialize(facts.where("tag = 'count'").groupBy("stat", "key").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), "terminality")
    vocabulary = total.where("stat IN ('word', 'in list') AND length(key) > 1").select(F.concat(F.lit("longer "), "stat").alias("stat"), "key", "n")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("key") - 1, F.lit(chars))), lambda i: F.substring("key", F.lit(1), i)))
    longer = vocabulary.select("stat", prefixes.alias("key"), "n").groupBy("stat", "key").agg(F.sum("n").alias("n"))
    start = F.substring("key", 1, chars)
    asked = facts.where((F.col("tag") == "ending") & F.col("stat").startswith("longer ") & (F.length("key") > chars)).select("stat", "key").distinct().withColumn("start", start)
    words = vocabulary.where(F.length("key") > chars).select("stat", F.col("key").alias("word"), "n", start.alias("start"))
    longest = asked.join(words, ["stat", "start"]).where(F.col("word").startswith(F.col("key")) & (F.col("word") != F.col("key"))).groupBy("stat", "key").agg(F.sum("n").alias("n"))
    return total.unionByName(longer.unionByName(longest).select("stat", "key", "n", F.lit(0).cast("bigint").alias("hits")))


def terminality(facts: DataFrame, *, support: int = 4) -> DataFrame:
    """(rep, verdict, score): score is the share of like endings that are ends, 0 cut to 1 closed.

    support: fewer other cases than this leave a count undecided, and the next coarser one decides.
    """
    counts = corpus_counts(facts)
    need = facts.where("tag = 'ending'").select("rep", "verdict", "kind", "stat", "key")
    joined = need.join(counts, ["stat", "key"], "left")
    stat = lambda s, c: F.max(F.when(F.col("stat") == s, F.coalesce(F.col(c), F.lit(0))))
    names = ["close code", "close url", "url", "in list", "pair list", "form list", "list", "dots2", "dots1", "open2", "open1", "in bare", "pair bare", "form bare", "bare1", "word", "longer word", "longer in list"]
    wide = joined.groupBy("rep", "verdict", "kind").agg(*(stat(s, c).alias(f"{s} {c}") for s in names for c in ("n", "hits")))
    col = lambda s, c="n": F.coalesce(F.col(f"`{s} {c}`"), F.lit(0))
    # shares without the text's own ending, which is in every count once, as a hit
    share = lambda s: (col(s, "hits") - 1) / (col(s) - 1)
    enough = lambda s: col(s) - 1 >= support
    of = lambda s, whole: F.when(col(whole) - 1 >= support, (col(s) - 1) / (col(whole) - 1)).otherwise(F.lit(0.0))
    if_enough = lambda s: F.when(enough(s), share(s)).otherwise(F.lit(0.0))
    # a word that stands nearly nowhere else, while longer words that begin with it are common
    half = lambda s: (col(f"longer {s}") >= 2) & (col(s) - 1 < 0.02 * col(f"longer {s}"))
    inside_word, inside_item = half("word"), half("word") | half("in list")
    unknown = ~enough("in bare") & ~enough("pair bare")
    closing = F.when(inside_word, F.lit(0.0)).when(unknown, F.lit(1.0)).otherwise(F.greatest(if_enough("in bare"), if_enough("pair bare"), 2 * of("form bare", "bare1")))
    opening = F.when(enough("open2"), share("open2")).when(enough("open1"), share("open1")).otherwise(F.when(F.col("kind") == "inline", F.lit(0.1)).otherwise(F.lit(0.5)))
    unlisted = ~enough("in list") & ~enough("pair list")
    listed = F.when(inside_item, F.lit(0.0)).when(unlisted & (col("list") - 1 < support), F.lit(1.0)).otherwise(F.greatest(if_enough("in list"), if_enough("pair list"), 2 * of("form list", "list")))
    coded = F.when(enough("close code"), share("close code")).otherwise(F.lit(0.0))
    linked = F.when(col("close url") >= F.greatest(F.lit(1), 0.003 * col("url")), F.lit(1.0)).otherwise(F.lit(0.0))
    dotted = F.when(enough("dots2"), share("dots2")).when(enough("dots1"), share("dots1")).otherwise(F.lit(0.0))
    score = (
        F.when(F.col("verdict") == "cut", F.lit(0.0))
        .when(F.col("verdict") == "closed", F.lit(1.0))
        .when(F.col("kind") == "code", coded)
        .when(F.col("kind") == "url", linked)
        .when(F.col("kind") == "list", listed)
        .when(F.col("kind") == "dots", dotted)
        .otherwise(F.sqrt(opening * F.least(closing, F.lit(1.0))))
    )
    return wide.select("rep", "verdict", F.least(score, F.lit(1.0)).cast("double").alias("score"))


# --- near-copies -----------------------------------------------------------------------------------------------------

#: Words of the beginnings that have band keys of their own: these and their doubles. Bands of a beginning, rows of each.
HEAD, HEAD_BANDS, HEAD_ROWS = 16, 8, 3

_ODD = np.uint64(0xBF58476D1CE4E5B9)


def _hash64(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


_LOWER, _EXACT = _Kept(lambda word: _hash64(word.lower())), _Kept(_hash64)


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_LOWER.__getitem__, words), np.uint64, len(words))


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order, from the words' hashes; of all words if there are fewer."""
    if len(h) <= 1:
        return h
    width = min(size, len(h))
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out = _mix(out) + h[i : len(h) - width + 1 + i]
    return _mix(out)


def _heads(words: int) -> list[int]:
    """Lengths of the beginnings of a text of so many words that have band keys."""
    return [HEAD << i for i in range(max(0, words // HEAD).bit_length())]


def band_rows(bodies: list[str], asks: np.ndarray, bands: int, rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the body, band key, whether it asks): bands of min-hash values of whole bodies and of their beginnings.

    A body that asks for a longer copy does so by its whole and by its longest
    beginning, which a copy of up to twice its length shares; it answers by all.
    """
    words_of = [body.split() for body in bodies]
    words = np.fromiter(map(len, words_of), np.int64, len(words_of))
    every = _word_hashes(list(itertools.chain.from_iterable(words_of)))
    runs, first = _shingles(every, size), np.cumsum(words) - words
    hashes, lengths, text_of, level_of, last = [], [], [], [], []
    for i, (n, at) in enumerate(zip(words.tolist(), first.tolist())):
        if not n:
            continue
        # runs over all bodies are those of a body as long as they stay within it
        h = runs[at : at + n - size + 1] if n >= size else _shingles(every[at : at + n], size)
        # parts between the ends of the beginnings
        ends = [0, *(m - size + 1 for m in _heads(n)), len(h)]
        for level, (a, b) in enumerate(zip(ends, ends[1:])):
            if b > a:
                hashes.append(h[a:b])
                lengths.append(b - a)
                text_of.append(i)
                level_of.append(level)
        last.append(len(lengths) - 1)
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h, starts = np.concatenate(hashes), np.r_[0, np.cumsum(lengths)[:-1]]
    text_of, level_of, last = np.array(text_of), np.array(level_of), np.array(last)
    rng = np.random.default_rng(8)
    a, b = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    mins = np.empty((len(starts), bands * rows), np.uint64)
    x, y = np.empty_like(h), np.empty_like(h)
    for j in range(bands * rows):
        # _mix in place
        np.multiply(h, a[j], out=x)
        np.add(x, b[j], out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint64(31), out=y), out=x)
        np.multiply(x, _ODD, out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint64(29), out=y), out=x)
        mins[:, j] = np.minimum.reduceat(x, starts)
    for level in range(1, level_of.max() + 1):
        at = np.flatnonzero(level_of == level)
        mins[at] = np.minimum(mins[at], mins[at - 1])
    whole = _keys(mins[last], bands, rows, 0)
    out = [(np.repeat(text_of[last], bands), whole.ravel(), np.repeat(asks[text_of[last]], bands))]
    for level in range(level_of.max() + 1):
        # the part of this level ends the beginning of HEAD << level words, if the text has as many
        at = np.flatnonzero((level_of == level) & (words[text_of] >= HEAD << level))
        longest = words[text_of[at]] < HEAD << (level + 1)
        keys = _keys(mins[at, : HEAD_BANDS * HEAD_ROWS], HEAD_BANDS, HEAD_ROWS, level + 1)
        out.append((np.repeat(text_of[at], HEAD_BANDS), keys.ravel(), np.repeat(asks[text_of[at]] & longest, HEAD_BANDS)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _keys(mins: np.ndarray, bands: int, rows: int, level: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1000 * level), (len(mins), bands))
    for r in range(rows):
        keys = _mix(keys + mins.reshape(len(mins), bands, rows)[:, :, r])
    return keys.view(np.int64)


def _align(size: int, threshold: float):
    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([aligned_cut(x, y, size, threshold) for x, y in zip(a, b)])

    return F.pandas_udf(judge, "string")


def aligned_cut(short: str, long: str, size: int = 5, threshold: float = 0.8) -> str:
    """How a text ends beside a longer near-copy: "cut" inside a sentence that this one goes on with, "end" where a sentence
    or line of this one ends and more follows, "" if they are no near-copies, do not align or end alike.

    Near-copies are similar as a whole, or the shorter one is to the longer up to where they are aligned.
    """
    words, other = strip_marker(short)[0].split(), strip_marker(long)[0].split()
    if len(words) < 4 or len(other) < 4:
        return ""
    # where the short copy's last words stand in the long one: the last may be half a word
    probe, last = words[-4:-1], words[-1]
    found = [i for i in range(len(other) - 3) if other[i + 3].startswith(last) and other[i : i + 3] == probe]
    if not found:
        return ""
    x, y = np.unique(_shingles(_word_hashes(words), size)), _shingles(_word_hashes(other), size)
    new = np.zeros(len(y), bool)
    new[np.unique(y, return_index=True)[1]] = True
    different, both = np.cumsum(new), np.cumsum(new & np.isin(y, x))
    similar = both / (len(x) + different - both)
    upto = np.clip(np.array(found) + 4 - size, 0, len(y) - 1)
    found = [i for i, s in zip(found, similar[upto]) if max(s, similar[-1]) >= threshold]
    if not found:
        return ""
    i = min(found, key=lambda i: abs(i + 4 - len(words)))
    whole = other[i + 3]
    if whole[len(last) :].strip(SENTENCE_END + "\"'"):
        return "cut"
    if i + 4 >= len(other):
        return ""
    return "end" if _ended(whole) or _line_break_after(long, other, i + 3) else "cut"


def _line_break_after(text: str, words: list[str], index: int) -> bool:
    """Whether the word of this index is the last of its line."""
    count = 0
    for line in text.split("\n"):
        count += len(line.split())
        if count > index:
            return count == index + 1
    return True


_RUNS = "rep bigint, run bigint, next string, core int, goes_on boolean, chars bigint"

#: Bits of the filter of wanted keys, as a power of two, and of the part of it that one row holds: 8 MB at most, whatever the input.
FILTER_BITS, BLOCK_BITS = 26, 14


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bits): the parts of the filter that the keys of this partition fall into."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
        for block in np.unique(at >> np.uint64(BLOCK_BITS)).tolist():
            here = at[at >> np.uint64(BLOCK_BITS) == block] & np.uint64((1 << BLOCK_BITS) - 1)
            blocks.setdefault(block, np.zeros(1 << BLOCK_BITS, bool))[here] = True
    if blocks:
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(blocks), pa.int32()), "bits": pa.array([np.packbits(b).tobytes() for b in blocks.values()], pa.binary())})


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bits by the keys' first ones. A key that is not among them passes at times, which the join after it mends; none is lost."""
    block = F.shiftrightunsigned("key", 64 - FILTER_BITS + BLOCK_BITS).alias("block")
    bits = np.zeros((1 << FILTER_BITS - BLOCK_BITS, 1 << BLOCK_BITS - 3), np.uint8)
    for row in keys.select("key", block).repartition("block").select("key").mapInArrow(_blocks, "block int, bits binary").collect():
        bits[row.block] = np.frombuffer(row.bits, np.uint8)
    return bits.ravel()


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - FILTER_BITS)
    return (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _runs(wanted):
    """(rep, run, next, core, goes_on, chars): each wanted three words in a row of a text, by hash, and the word after them.

    core is the length of the next word without sentence marks and quotes; goes_on
    tells whether its sentence and line go on after it, null if no word follows.
    """
    schema = pa.schema([("rep", pa.int64()), ("run", pa.int64()), ("next", pa.string()), ("core", pa.int32()), ("goes_on", pa.bool_()), ("chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, texts = batch.column("rep").to_pylist(), batch.column("text").to_pylist()
            for start in range(0, len(texts), 2000):
                bodies = [strip_marker(t)[0] for t in texts[start : start + 2000]]
                words_of = [body.split() for body in bodies]
                counts = np.fromiter(map(len, words_of), np.int64, len(words_of))
                every = _shingles(_exact_hashes(list(itertools.chain.from_iterable(words_of))), 3)
                first = np.cumsum(counts) - counts
                at = np.flatnonzero(_passes(wanted.value, every))
                of = np.searchsorted(first, at, "right") - 1
                # the last text that begins there is the one with words; three words of it and one after them
                inside = at - first[of] + 3 < counts[of]
                found: dict[tuple, None] = {}
                lines: dict[int, set] = {}
                for t, i, h in zip(of[inside].tolist(), (at - first[of])[inside].tolist(), every[at[inside]].view(np.int64).tolist()):
                    words = words_of[t]
                    if t not in lines:
                        lines[t] = set(np.cumsum([len(line.split()) for line in texts[start + t].split("\n")]) - 1)
                    word = words[i + 3]
                    goes_on = not _ended(word) and i + 3 not in lines[t] if i + 4 < len(words) else None
                    found[reps[start + t], h, word, len(word.rstrip(SENTENCE_END + "\"'")), goes_on, len(bodies[t])] = None
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return run


def _exact_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_EXACT.__getitem__, words), np.uint64, len(words))


def _last_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, run, last, chars): the three words before a text's last one, by hash, and the last one."""
    schema = pa.schema([("rep", pa.int64()), ("run", pa.int64()), ("last", pa.string()), ("chars", pa.int64())])
    for batch in batches:
        rows = []
        for rep, text in zip(batch.column("rep").to_pylist(), batch.column("text").to_pylist()):
            body = strip_marker(text)[0]
            words = body.split()
            if len(words) >= 4:
                rows.append((rep, int(_shingles(_exact_hashes(words[-4:-1]), 3).view(np.int64)[0]), words[-1], len(body)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _sets(texts: list[str], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text the characters of its body and its different shingles, in order."""
    bodies = [strip_marker(t)[0] for t in texts]
    words_of = [body.split() for body in bodies]
    every = _word_hashes(list(itertools.chain.from_iterable(words_of)))
    runs, at = _shingles(every, size), 0
    for body, words in zip(bodies, words_of):
        n = len(words)
        h = runs[at : at + n - size + 1] if n >= size else _shingles(every[at : at + n], size)
        at += n
        yield len(body), h[np.sort(np.unique(h, return_index=True)[1])]


_COMMON = "key bigint"
_CHOSEN = "rep bigint, key bigint, least int, reach int, chars bigint"
_HELD = "key bigint, other bigint, place int, whole_chars bigint"


def _shingle_keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h for _, h in _sets(batch.column("text").to_pylist(), size)]
            if sets:
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(sets).view(np.int64))})

    return run


def _choose(common, size: int, threshold: float, extra: int):
    """(rep, key, least, reach, chars): the rarest shingles of a text of which a near-copy must hold at least ``least``.

    A near-copy holds ``threshold`` of all the n shingles, so it lacks n - need at
    most: of any n - need + e it holds e. Those it shares stand among its first
    n / threshold. Which ones are chosen only moves work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = common.value
        for batch in batches:
            out = []
            for rep, (chars, h) in zip(batch.column("rep").to_pylist(), _sets(batch.column("text").to_pylist(), size)):
                n = len(h)
                lacks = n - int(np.ceil(threshold * n - 1e-9))
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                often = np.where(keys[at] == h, times[at], 0) if len(keys) else np.zeros(n, np.int64)
                chosen = h[np.lexsort((h, often))][: lacks + extra]
                least, reach = len(chosen) - lacks, int(n / threshold + 1e-9)
                out.extend((rep, k, least, reach, chars) for k in chosen.view(np.int64).tolist())
            if out:
                yield pa.RecordBatch.from_pydict({name: pa.array(c, kind) for name, kind, c in zip(("rep", "key", "least", "reach", "chars"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), zip(*out))})

    return run


def _hold(wanted, size: int):
    """(key, other, place, whole_chars): the wanted shingles of a text, and how many different ones it has up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, texts = batch.column("rep").to_numpy(), batch.column("text").to_pylist()
            for start in range(0, len(texts), 2000):
                chars, sets = zip(*_sets(texts[start : start + 2000], size))
                counts = np.fromiter(map(len, sets), np.int64, len(sets))
                every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
                place = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                on = _passes(wanted.value, every)
                if on.any():
                    yield pa.RecordBatch.from_pydict({"key": pa.array(every[on].view(np.int64)), "other": pa.array(reps[start : start + 2000][of[on]]), "place": pa.array(place[on], pa.int32()), "whole_chars": pa.array(np.array(chars)[of[on]], pa.int64())})

    return run


def _seek(size: int, threshold: float):
    """(rep, aligned) of the texts that wait in a group for what one of the longer texts that come after them shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting = None, []
        for batch in batches:
            done = []
            for key, kind, rep, whole, chars, text in zip(*(batch.column(c).to_pylist() for c in ("grp", "kind", "rep", "is_whole", "chars", "text"))):
                if key != group:
                    group, waiting = key, []
                if not whole:
                    waiting.append((rep, chars, text))
                    continue
                left = []
                for x in waiting:
                    if x[1] < chars and aligned_cut(x[2], text, size, threshold) == kind:
                        done.append((x[0], kind))
                    else:
                        left.append(x)
                waiting = left
            yield pa.RecordBatch.from_pydict({"rep": pa.array([d[0] for d in done], pa.int64()), "aligned": pa.array([d[1] for d in done], pa.string())})

    return run


def aligned_by_index(texts: DataFrame, shingle: int, threshold: float, *, starts: int = 64, extra: int = 3, sample: int = 20_000, known: int = 200_000, many: int = 1000, first: int = 16) -> DataFrame:
    """(rep, aligned) of the texts(rep, text, asks) that ask and end early beside a longer near-copy among them, however many there are.

    A text's last four words are looked up among all runs of four words, the last
    word as the beginning of one, where text follows. Texts whose ending goes on
    elsewhere meet those that hold enough of their rarest shingles, which every
    near-copy does, and only then are texts aligned, until the first proof of a cut
    and of an end. Neither the order nor the beginning of the texts matters.

    Of last words over ``starts`` characters the beginning finds the run. Which
    shingles are rare is estimated from about ``sample`` texts, the ``known`` most
    frequent ones are told apart. A text with over ``many`` meetings tries its
    ``first`` best ones of a part of them, and meets all if they prove nothing.
    """
    spark = texts.sparkSession
    share = lambda value: spark.sparkContext.broadcast(value)
    endings = materialize(texts.where("asks").select("rep", "text").mapInArrow(_last_run, "rep bigint, run bigint, last string, chars bigint"), "endings")
    endings = endings.withColumn("start", F.substring("last", 1, starts))
    bodies = texts.select("rep", "text")
    wanted = endings.groupBy("run").agg(F.collect_set(F.length("start")).alias("lengths"))
    read_runs = _runs(share(_filter_of(endings.select(F.col("run").alias("key")).distinct())))
    runs = bodies.mapInArrow(read_runs, _RUNS).select("run", "next", "core", "goes_on").distinct()
    begun = F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("next")), lambda n: F.substring(F.col("next"), F.lit(1), n)))
    met = materialize(runs.join(wanted, "run").select("run", "next", "core", "goes_on", begun.alias("start")), "runs")
    # an ending that no text goes on with leaves here, before any texts are paired
    x, y = endings.select("run", "start", "last").distinct().alias("x"), met.alias("y")
    same = (F.col("x.run") == F.col("y.run")) & (F.col("x.start") == F.col("y.start")) & F.col("y.next").startswith(F.col("x.last"))
    kind = F.when((F.col("core") > F.length("last")) | F.col("goes_on"), "cut").when(~F.col("goes_on"), "end")
    proofs = materialize(x.join(y, same).select("x.run", "last", "next", F.coalesce(F.col("goes_on").cast("int"), F.lit(-1)).alias("goes_on"), kind.alias("kind")).where("kind IS NOT NULL"), "proofs")
    by = ["run", "last", "kind"]
    waiting = materialize(endings.join(proofs.select(*by).distinct(), ["run", "last"]).select("rep", *by, "chars"), "waiting")

    part = max(1, texts.count() // sample)
    counted = bodies.where(F.pmod(F.xxhash64("rep"), F.lit(part)) == 0).mapInArrow(_shingle_keys(shingle), _COMMON).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    common = counted.where("n > 1").orderBy(F.desc("n"), "key").limit(known).toArrow()
    keys, times = common.column("key").to_numpy().view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(keys)
    asking = bodies.join(waiting.select("rep").distinct(), "rep")
    chosen = materialize(asking.mapInArrow(_choose(share((keys[order], times[order])), shingle, threshold, extra), _CHOSEN), "chosen")
    held = materialize(bodies.mapInArrow(_hold(share(_filter_of(chosen.select("key").distinct())), shingle), _HELD).join(chosen.select("key").distinct(), "key", "left_semi"), "held")

    def meetings(some: DataFrame, holders: DataFrame, enough: bool) -> DataFrame:
        """(rep, kind, other, n) of texts that hold enough of another's shingles and go on after its last words."""
        near = some.join(holders, "key").where("place <= reach AND chars < whole_chars")
        near = near.groupBy("rep", "other").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least"), F.first("whole_chars").alias("whole_chars"))
        near = materialize(near.where("n >= least") if enough else near, "near")
        others = bodies.join(near.select(F.col("other").alias("rep")).distinct(), "rep", "left_semi").mapInArrow(read_runs, _RUNS)
        carriers = others.select("run", "next", F.coalesce(F.col("goes_on").cast("int"), F.lit(-1)).alias("goes_on"), F.col("rep").alias("other"))
        return near.join(waiting.drop("chars"), "rep").join(proofs, by).join(carriers, ["run", "next", "goes_on", "other"], "left_semi").select("rep", "kind", "other", "n", "whole_chars").distinct()

    def seek(pairs: DataFrame) -> DataFrame:
        grp = F.xxhash64("grp", "kind").alias("grp")
        lone = waiting.join(pairs.select("rep", "kind").distinct(), ["rep", "kind"], "left_semi").select(F.col("rep").alias("grp"), "kind", "rep", F.lit(False).alias("is_whole"), "chars")
        passing = pairs.select(F.col("rep").alias("grp"), "kind", F.col("other").alias("rep"), F.lit(True).alias("is_whole"), F.col("whole_chars").alias("chars"))
        rows = lone.unionByName(passing).withColumn("grp", grp).join(bodies, "rep")
        return rows.repartition("grp").sortWithinPartitions("grp", "is_whole", "chars").mapInArrow(_seek(shingle, threshold), "rep bigint, aligned string")

    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    heavy = materialize(chosen.join(often, "key").groupBy("rep").agg(F.sum("n").alias("n")).where(F.col("n") > many).select("rep"), "heavy")
    if heavy.isEmpty():
        return seek(materialize(meetings(chosen, held, True), "pairs"))
    few = held.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("other"), "other"))).where(F.col("at") <= 4 * first).drop("at")
    best = meetings(chosen.join(heavy, "rep", "left_semi"), few, False).withColumn("at", F.row_number().over(Window.partitionBy("rep", "kind").orderBy(F.desc("n"), "other"))).where(F.col("at") <= first)
    tried = materialize(seek(materialize(best, "best")), "tried")
    # what a cut shows is settled, and so is an end where nothing waits for a cut
    open_cuts = waiting.where("kind = 'cut'").select("rep").distinct().join(tried.where("aligned = 'cut'"), "rep", "left_anti")
    open_ends = waiting.where("kind = 'end'").select("rep").distinct().join(tried, "rep", "left_anti")
    rest = chosen.join(open_cuts.unionByName(open_ends).distinct(), "rep", "left_semi")
    return tried.unionByName(seek(materialize(meetings(rest, held, True), "pairs")))


def near_copy_endings(facts: DataFrame, distinct: DataFrame, *, shingle: int = 5, threshold: float = 0.8, small: int = 32) -> DataFrame:
    """(rep, aligned): "cut" or "end" for texts that end early beside a longer near-copy.

    A bucket of up to ``small`` texts compares each that asks with the longer ones.
    Texts of larger ones are looked up by their endings, with the same result.
    """
    banded = facts.where("tag = 'band'").select("band", "rep", F.col("n").alias("chars"), (F.col("hits") > 0).alias("asks"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asked")).where("n > 1 AND asked").drop("asked")
    met = materialize(banded.join(sizes, "band"), "met")
    cold = met.where(F.col("n") <= small)
    x, y = cold.where("asks").alias("x"), cold.alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.chars") < F.col("y.chars"))).select(F.col("x.rep").alias("rep"), F.col("y.rep").alias("other")).distinct()
    texts = distinct.select("rep", "text")
    both = pairs.join(texts, "rep").join(texts.select(F.col("rep").alias("other"), F.col("text").alias("whole")), "other")
    judged = both.select("rep", _align(shingle, threshold)(F.col("text"), F.col("whole")).alias("aligned")).where("aligned <> ''")
    large = met.where(F.col("n") > small).groupBy("rep").agg(F.max("asks").alias("asks"))
    if not large.isEmpty():
        judged = judged.unionByName(aligned_by_index(materialize(large.join(texts, "rep"), "large"), shingle, threshold))
    return judged.groupBy("rep").agg(F.min("aligned").alias("aligned"))


def truncated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cutoff: float = 0.5, phrase: int = 5, bands: int = 20, rows: int = 5, shingle: int = 5) -> DataFrame:
    """(doc_id, score, aligned, is_cut) of every document whose text is not null or blank.

    is_cut: a longer near-copy goes on inside the sentence; or the ending is open by
    itself; or its score is below ``cutoff`` and no longer near-copy's sentence ends
    there. Repeated doc_id are judged text by text and cut if any is. A null doc_id
    keeps its row. Texts are read whole, however long; an empty table gives no row;
    further columns are ignored.

    phrase: exact copies of a text are one case, so that they are no evidence for
    each other. Only a text of at most so many words counts each time: it is too
    short to be a copy and written anew.
    """
    texts = docs.where(F.col(text).isNotNull() & F.col(text).rlike(r"[^\s\p{Z}]")).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    reps = texts.select("doc_id", F.xxhash64("text").alias("rep"), "text")
    distinct = reps.groupBy("rep", "text").agg(F.count(F.lit(1)).alias("copies"))
    short = F.size(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")) <= phrase
    distinct = materialize(distinct.select("rep", "text", F.when(short, F.col("copies")).otherwise(F.lit(1)).cast("bigint").alias("times")), "texts")
    facts = materialize(distinct.mapInArrow(_reader(bands, rows, shingle), FACTS), "facts", partition_by=["tag"])
    judged = terminality(facts).join(near_copy_endings(facts, distinct, shingle=shingle), "rep", "left")
    aligned = F.coalesce("aligned", F.lit(""))
    is_cut = (aligned == "cut") | (F.col("verdict") == "cut") | ((F.col("score") < cutoff) & (aligned != "end"))
    judged = judged.select("rep", "score", "aligned", is_cut.alias("is_cut"))
    return reps.select("doc_id", "rep").join(judged, "rep").groupBy("doc_id").agg(F.min("score").alias("score"), F.min("aligned").alias("aligned"), F.max("is_cut").alias("is_cut"))


def source_name(column: Column) -> Column:
    return F.lower(F.trim(column))


def rates(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(source, texts, cut, rate); sources are compared without case and outer blanks, null is a source of its own, and so is a null doc_id a document."""
    flags = found.select(F.col("doc_id").alias("f_doc"), "is_cut")
    joined = docs.select(doc_id, source_name(F.col(source)).alias("source")).join(flags, F.col(doc_id).eqNullSafe(F.col("f_doc")))
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("is_cut").cast("bigint")).alias("cut")).withColumn("rate", F.col("cut") / F.col("texts"))
