"""Texts whose end is missing.

Two kinds of evidence are joined. A text that is a strict prefix of another one and breaks off inside a
line lost its end (found by sorting: the nearest longer text follows its prefix). As most cut texts have
no longer copy, the corpus itself says how texts end: for the last words of a text, with names, numbers,
paths and interchangeable words masked, it counts how often they end a sentence or line and how often
they go on. Open structures, halves of words and lengths at which a source's texts pile up add to that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.session import durable

GRAMS = 5
#: Runs of word signs with what joins them, line ends, fences and single signs; runs are cut into tokens once and kept.
_CHUNK = re.compile(r"[\w.:/'’-]++|\n\s*+|```|[^\w\s]")
_QUOTES = re.compile(r"(['’])")
_PIECE = re.compile(r"[^\W\d_]++(?:['’][^\W\d_]++)*+(?!\w)|\w++|[^\w\s]")
_LETTERS_OR_DIGITS = re.compile(r"\d++|[^\W\d_]++|_")
_NAME = re.compile(r"[a-z0-9][A-Z]|_")
_HEX = re.compile(r"(?=\d*[a-f])[0-9a-f]*\d[0-9a-f]*")
_EXTENSION = re.compile(r"\w\.[A-Za-z]{1,5}$")
_SUBWORD = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])")
_PARTS = re.compile(r"[A-Z]?[^\W\d_A-Z]++|[A-Z]++(?![^\W\d_A-Z])")
_STOP = re.compile(r"[.!?。؟][\"'’”»)\]*_`]*$")
_HALF_PATH = re.compile(r"(?:^|[\s`(\"'])(?!/)[\w-]+(?:/[\w-]+)+\.$")
_ENDS = frozenset({".", "!", "?", "\n", "。"})
_ROUTE = re.compile(r"/(?P<last>[\w:-]*)$")
_WHOLE_ROUTE = re.compile(r"(?<![\w./-])/(?:[\w:-]*+/)*+([\w:-]++)(?=[\s.,;:)`\"']|$)")
_P, _MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def _masked(w: str) -> str:
    """A token as it is counted: in lower case, numbers, names and hexadecimal strings as such."""
    if w[0].isdigit() and w.isdigit():
        return "0"
    if len(w) > 1 and _NAME.search(w):
        return "<name>"
    return f"<hex{len(w)}>" if _HEX.fullmatch(w) else w.lower()


def _pieces(run: str) -> Iterator[str]:
    """Masked tokens of a run without slashes."""
    for w in _PIECE.findall(run):
        bare = w.lstrip("_")
        yield from "_" * (len(w) - len(bare)) if bare else w
        if not bare:
            continue
        if bare.isalpha() or not bare[0].isalnum() or _NAME.search(bare) or _HEX.fullmatch(bare) or "'" in bare or "’" in bare:
            yield _masked(bare)
        else:
            yield from map(_masked, _LETTERS_OR_DIGITS.findall(bare))


def chunk_tokens(chunk: str) -> tuple[str, ...]:
    """Masked tokens of one match of the chunk pattern."""
    if chunk[0] == "\n":
        return ("\n",)
    # Plain words and numbers, with what sentences put behind them, are most of all chunks.
    word = chunk.rstrip(".:-")
    if word.isalpha():
        return (_masked(word), *chunk[len(word) :])
    if word.isdigit():
        return ("0", *chunk[len(word) :])
    if "/" not in chunk or len(chunk) == 1:
        return tuple(_pieces(chunk)) if chunk != "```" else (chunk,)
    out: list[str] = []
    for part in _QUOTES.split(chunk):
        if "/" in part and len(part) > 1:
            out.append("<file>" if _EXTENSION.search(part) else "<route>" if part[0] == "/" else "<path>")
        else:
            out += _pieces(part)
    return tuple(out)


class Kept(dict):
    """What is made of a chunk, made when first met; up to ``most`` short chunks are kept."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk: str):
        made = self.make(chunk)
        if len(self) < self.most and len(chunk) < 100:
            self[chunk] = made
        return made


_tokens_of = Kept(chunk_tokens).__getitem__


def tokens(text: str) -> list[str]:
    """Words in lower case, signs and line ends; names, numbers, paths and hexadecimal strings are masked."""
    return list(chain.from_iterable(map(_tokens_of, _CHUNK.findall(text))))


def base_of(text: str) -> tuple[str, bool]:
    """The text without white space and dots of omission at its end, and whether there were such dots."""
    text = text.rstrip()
    bare = text[:-1] if text.endswith("…") else text.rstrip(".") if text.endswith("..") else text
    return (bare.rstrip(), True) if bare and bare != text else (text, False)


def by_structure(base: str, marked: bool) -> bool | None:
    """True if a structure is open at the end, False if the text ends with a stop, None if neither says."""
    if base.endswith("�"):
        return True
    if "```" in base and len(re.findall(r"(?m)^\s*```", base)) % 2:
        return True
    last_line = base[base.rfind("\n") + 1 :]
    if not marked and _STOP.search(base):
        return True if _HALF_PATH.search(last_line) else False
    if any(base.count(o) > base.count(c) for o, c in ("{}", "()", "[]")):
        return True
    if last_line.count("`") % 2 and not last_line.lstrip().startswith("```"):
        return True
    return None


class Hasher(dict):
    """64-bit hashes of words, the same in every process; interchangeable words share one."""

    def __init__(self, open_words: frozenset[str] = frozenset()):
        super().__init__()
        self.open_words = open_words

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest("<open>" if word in self.open_words else word)
        if len(self) < 500_000:
            self[word] = h
        return h


_plain = Hasher()
_hashes_of = Kept(lambda chunk: tuple(map(_plain.__getitem__, chunk_tokens(chunk)))).__getitem__


def tail_grams(ids: list[int]) -> list[int]:
    """Numbers of the last 1, 2, ... GRAMS words by their hashes (signed, as Spark keeps them)."""
    out = []
    for n in range(1, min(GRAMS, len(ids)) + 1):
        h = 0
        for x in ids[-n:]:
            h = (h * int(_P) + x) & _MASK
        h &= ~3 & _MASK
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def _word_rows(texts: list[str]) -> tuple[list, list, list, list]:
    """kinds, contexts, words and counts: words between their neighbours, complete subwords, complete ends of routes."""
    chunks, subwords, routes = [], Counter(), Counter()
    for text in texts:
        base, _ = base_of(text)
        chunks += _CHUNK.findall(base)
        chunks.append("\n")
        if "/" in base:
            routes.update(m[1] for m in _WHOLE_ROUTE.finditer(base) if m.end() < len(base))
        # A subword at the very end of a text isn't known to be complete.
        if chunks[-2:-1] and base.endswith(chunks[-2]):
            for w in _PARTS.findall(chunks[-2])[-1:]:
                if base.endswith(w):
                    subwords[w.lower()] -= 1
    counted, named = Counter(chunks), {}
    for chunk, n in counted.items():
        named.update(zip(_hashes_of(chunk), _tokens_of(chunk)))
        for w in _PARTS.findall(chunk):
            subwords[w.lower()] += n
    complete = {w: n for w, n in subwords.items() if n > 0}
    # Words and their contexts as numbers; a text's border counts as a line end.
    hashes, codes = np.unique(np.fromiter(chain.from_iterable(map(_hashes_of, chunks)), np.uint64), return_inverse=True)
    names = [named[h] for h in hashes.tolist()]
    telling = np.array([len(w) > 2 and w[0].isalpha() for w in names]) if names else np.zeros(0, bool)
    ends = names.index("\n") if "\n" in names else -1
    middle = np.flatnonzero(telling[codes[1:-1]] & (codes[:-2] != ends) & (codes[2:] != ends)) + 1 if len(codes) > 2 else np.zeros(0, int)
    contexts = hashes[codes[middle - 1]] * _P + hashes[codes[middle + 1]]
    inner = codes[middle]
    # Equal pairs of context and word come together by one number for both.
    order = np.argsort(contexts * _P ^ hashes[inner]) if len(inner) else inner
    contexts, inner = contexts[order], inner[order]
    starts = np.flatnonzero(np.concatenate(([True], (contexts[1:] != contexts[:-1]) | (inner[1:] != inner[:-1])))) if len(inner) else np.zeros(0, int)
    counts = np.diff(np.append(starts, len(inner)))
    kinds = [0] * len(starts) + [1] * len(complete) + [2] * len(routes)
    return kinds, [*contexts[starts].view(np.int64).tolist(), *[0] * (len(complete) + len(routes))], [*(names[i] for i in inner[starts]), *complete, *routes], [*counts.tolist(), *complete.values(), *routes.values()]


def corpus_words(texts: DataFrame) -> DataFrame:
    """kind, context, word and n over all distinct texts, written once (see ``_word_rows``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _word_rows(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.int64()))], names=["kind", "context", "word", "n"])

    rows = texts.select("content").mapInArrow(run, "kind int, context bigint, word string, n bigint")
    return durable(rows.groupBy("kind", "context", "word").agg(F.sum("n").alias("n")))


def interchangeable(words: DataFrame, fillers: int = 12, most: int = 200_000) -> frozenset[str]:
    """Words that stand, on average over their occurrences, where at least ``fillers`` different words stand.

    Only words with a share of at least 1 / ``most`` of all occurrences (and 5 of them) are looked at, so
    there can be no more than ``most`` of them; they are the model that every task is given.
    """
    triples = words.where("kind = 0").select("context", "word", "n")
    places = triples.groupBy("context").agg(F.least(F.count("*"), F.lit(200)).alias("width"))
    scored = triples.join(places, "context").groupBy("word").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("width")) / F.sum("n")).alias("score"))
    total = triples.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.word for r in scored.where((F.col("n") >= max(5, total / most)) & (F.col("score") >= fillers)).select("word").collect())


READ = "gram bigint, ended bigint, went_on bigint, last bigint, text binary, decided boolean, grams array<bigint>, befores array<bigint>, subword string, route string"


def read_texts(texts: DataFrame, open_words) -> DataFrame:
    """One reading of all distinct texts (text, content), written once: rows with a ``gram`` or with a ``text``.

    A gram row counts, for a sequence of up to GRAMS masked words, how often an end (``ended``), another word
    (``went_on``) or nothing (``last``) follows; counts are combined per batch. A text row says how the text
    ends: ``decided`` by its structure, or else the hashes of its last words (``grams``) and of those before
    the last one (``befores``), its last subword and the end of a route. Blank texts have neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(open_words.value)
        hashes_of = Kept(lambda chunk: tuple(map(hasher.__getitem__, chunk_tokens(chunk)))).__getitem__
        ends = np.array(sorted(map(hasher.__getitem__, _ENDS)), np.uint64)
        types = pa.schema([(n, t) for n, t in zip(re.findall(r"(\w+) [\w<>]+(?:,|$)", READ), (pa.int64(),) * 4 + (pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string()))])

        def rows(at: int, columns: list) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.nulls(n, t.type) if not at <= i < at + len(columns) else pa.array(columns[i - at], t.type) for i, t in enumerate(types)], schema=types)

        for batch in batches:
            ids: list[int] = []
            sizes: list[int] = []
            said = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, marked = base_of(text)
                before = len(ids)
                ids += chain.from_iterable(map(hashes_of, _CHUNK.findall(base)))
                sizes.append(len(ids) - before)
                if not base.strip():
                    continue
                decided = by_structure(base, marked)
                if decided is not None:
                    said.append((name, decided, None, None, None, None))
                    continue
                word = base[base.rfind(" ") + 1 :]
                route = _ROUTE.search(word) if word.startswith("/") else None
                tail = ids[max(before, len(ids) - GRAMS) :]
                said.append((name, None, tail_grams(tail), tail_grams(tail[:-1]), last_subword(base), route and route["last"] or None))
            if said:
                yield rows(4, list(zip(*said)))
            if not ids:
                continue
            ids_, sizes_ = np.array(ids, np.uint64), np.array(sizes)
            stops = np.append(np.isin(ids_[1:], ends), False).astype(np.uint64)
            # What follows each word: 1 an end, 0 another word, 2 nothing.
            stops[np.cumsum(sizes_)[sizes_ > 0] - 1] = 2
            place = np.arange(len(ids_)) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
            # A gram and what follows it share one number, the latter in its last two bits, so that sorting numbers is all.
            kept, h = [], np.zeros(len(ids_), np.uint64)
            for n in range(1, GRAMS + 1):
                # h(i) over n words is made from h(i - 1) over n - 1 words.
                h = np.concatenate((np.zeros(1, np.uint64), h[:-1])) * _P + ids_
                kept.append(((h & ~np.uint64(3)) | stops)[place >= n - 1])
            both = np.sort(np.concatenate(kept))
            grams, kinds = both & ~np.uint64(3), both & np.uint64(3)
            starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            yield rows(0, [grams[starts].view(np.int64), *(np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in (1, 0, 2))])

    return durable(texts.select("text", "content").mapInArrow(run, READ))


def last_subword(base: str) -> str | None:
    """The subword, in lower case, that a text ends with, if it ends with one."""
    at = len(base)
    while at and (base[at - 1].isalnum() or base[at - 1] == "_"):
        at -= 1
    last = None
    for last in _SUBWORD.finditer(base, at):
        pass
    return last[0].lower() if last and last.end() == len(base) else None


def _breaks(text: str, longer: str) -> bool:
    """Whether ``longer`` goes on inside the word or sentence that ``text`` ends in."""
    return longer.startswith(text) and _goes_on(text, longer[len(text) : len(text) + 2])


def _goes_on(text: str, signs: str) -> bool:
    """For a text and the next two signs of a longer one: whether they stand in one word, or, after GRAMS words or more, in one sentence.

    Fewer words are shared by chance, as headings and longer sentences are; what is left open there is
    judged by how these words go on in the whole corpus.
    """
    here = text[-1:] + signs
    return re.match(r"\w\w", here) is not None or (text.count(" ") >= GRAMS - 1 and re.match(r"[\w,] \w", here) is not None)


def _common(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


class Prefixes:
    """Texts in order, each tested against the open texts before it that it extends.

    In order, a text's extensions follow it directly, so the texts that are prefixes of the current one form
    a stack. A text leaves it when one of its extensions goes on where it breaks off, or when no more can come.
    """

    def __init__(self):
        self.open: list[tuple[str, list]] = []

    def close(self, text: str) -> None:
        """Close what ``text`` doesn't extend."""
        while self.open and not text.startswith(self.open[-1][0]):
            self.open.pop()

    def meet(self, text: str) -> list:
        """Names of the open texts that break off inside ``text``."""
        self.close(text)
        found = [x for x in self.open if len(x[0]) < len(text) and _breaks(x[0], text)]
        if found:
            self.open = [x for x in self.open if x not in found]
        return [name for _, names in found for name in names]

    def put(self, text: str, name) -> None:
        if self.open and self.open[-1][0] == text:
            self.open[-1][1].append(name)
        else:
            self.open.append((text, [name]))


def strict_prefixes(texts: DataFrame, head: int = 1024) -> DataFrame:
    """``text`` of the distinct texts (text, content) that are strict prefixes of another content and break off inside it.

    A content is compared with every one of its extensions. Contents are sorted over ranges of their first
    ``head`` signs, so that no long content is drawn as a sample of the ranges. Each range gives off its open
    contents, its first one, and, for each length that another one of its contents shares with the first,
    the signs there: with these, one pass over the few rows of all ranges tests open contents against the
    ranges that follow. Dots of omission at the end are left off. A prefix that is followed by a line end, a
    stop or another sign is no break.
    """
    blank = F.lit(" \t\r\n\x0b\x0c\xa0")
    end = F.rtrim("content", blank)
    bare = F.when(end.endswith(".."), F.rtrim(F.rtrim(end, F.lit(".")), blank)).when(end.endswith("…"), F.rtrim(F.regexp_replace(end, "…$", ""), blank)).otherwise(end)
    bare = texts.select("text", bare.alias("bare")).where("bare != ''").withColumn("head", F.substring("bare", F.lit(1), F.lit(head)))
    ordered = bare.repartitionByRange("head").sortWithinPartitions("head", "bare").select("text", "bare")
    schema = "part int, place int, edge string, text binary, bare string"

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else ([],) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()))], names=["part", "place", "edge", "text", "bare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, first, branches = TaskContext.get().partitionId(), Prefixes(), None, set()
        for batch in batches:
            found = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first is None:
                    first = text
                    found.append((part, 0, "first", None, text))
                elif first and (shared := _common(first, text)):
                    # Ranges before this one may hold a prefix that ends here: the sign before and the two after.
                    branches.add((shared, text[shared - 1 : shared + 2]))
                    if shared < len(first):
                        first = first[: shared + 2]
                else:
                    first = ""
                found += [(part, 0, "cut", x, None) for x in seen.meet(text)]
                seen.put(text, name)
            yield batch_of(found)
        yield batch_of([(part, shared, "branch", None, signs) for shared, signs in branches] + [(part, len(text), "open", x, text) for text, names in seen.open for x in names])

    found = durable(ordered.mapInArrow(run, schema))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Prefixes()
        for batch in batches:
            cut = []
            for _, place, edge, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if edge == "first":
                    cut += seen.meet(text)
                elif edge == "open":
                    seen.close(text)
                    seen.put(text, name)
                else:
                    # A branch at one length tells of prefixes of this length and of one sign less.
                    here = [x for x in seen.open if len(x[0]) == place and _goes_on(x[0], text[1:]) or len(x[0]) == place - 1 and _goes_on(x[0], text[:2])]
                    seen.open = [x for x in seen.open if x not in here]
                    cut += [n for _, names in here for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["text"])

    # One range's rows come in the order first, branches, open ones by length. There are a few rows per range, however many texts it has.
    order = F.when(F.col("edge") == "first", 0).when(F.col("edge") == "branch", 1).otherwise(2)
    edges = found.where("edge != 'cut'").withColumn("o", order).coalesce(1).sortWithinPartitions("part", "o", "place", "bare").select("part", "place", "edge", "text", "bare")
    return found.where("edge = 'cut'").select("text").unionByName(edges.mapInArrow(across, "text binary"))


def piled_lengths(tail: DataFrame, least: int = 8, times: float = 6.0) -> DataFrame:
    """source, measure ('chars' or 'bytes') and length at which a source has far more documents than around it.

    ``tail`` has source, chars, bytes, decided and n, the number of documents. Texts that end with a stop
    don't count, so lengths of whole texts pile up less. The window runs over a source's distinct lengths,
    not over its rows.
    """
    measured = tail.where("decided is null or decided").select("source", "n", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("measure", "length"))
    counts = measured.groupBy("source", "measure", "length").agg(F.sum("n").alias("n"))
    near = W.partitionBy("source", "measure").orderBy("length").rangeBetween(-15, 15)
    around = (F.sum("n").over(near) - F.col("n")) / F.lit(30.0)
    return counts.withColumn("around", around).where((F.col("n") >= least) & (F.col("n") >= times * F.greatest("around", F.lit(0.3)))).select("source", "measure", "length")


def judged_endings(read: DataFrame, words: DataFrame, went_on_share: float, seen: int, usual: float = 0.02) -> DataFrame:
    """ending, subword_complete, cut and cut_at_limit of each distinct way in which texts end that their structure doesn't decide.

    Other texts that end likewise speak for a whole text only if at least ``usual`` of what follows the words
    before the last one ends there, as headings do. Else the more texts there are, the more of them are cut
    at the same place, and they would speak for each other.
    """
    vocabulary = words.where("kind = 1 and n >= 2").select("word")
    halves = vocabulary.where("length(word) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("subword")).distinct()
    ends = read.where("text is not null and decided is null").select(F.expr(ENDING).alias("ending"), "grams", "befores", "subword", "route").dropDuplicates(["ending"])
    counts = read.where("gram is not null").groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("ended", "went_on", "last")))
    at = lambda grams, before: F.transform(grams, lambda g, i: F.struct((i + int(before)).alias("pos"), F.lit(before).alias("before"), g.alias("gram")))
    asked = ends.select("ending", F.inline(F.concat(at("grams", False), at("befores", True))))
    both = asked.join(counts, "gram").groupBy("ending", "pos").agg(*(F.sum(F.when(~F.col("before"), F.col(c))).alias(c) for c in ("ended", "went_on", "last")), F.sum(F.when(F.col("before"), F.col("went_on"))).alias("followed"))
    alike = F.when(F.col("last") >= usual * F.coalesce("followed", F.lit(0)), F.greatest(F.col("last") - 1, F.lit(0))).otherwise(0)
    answers = both.withColumn("total", F.col("ended") + F.col("went_on") + alike)
    best = answers.where(F.col("total") >= seen).groupBy("ending").agg(F.max_by(F.struct((F.col("pos") + 1).alias("words"), (F.col("went_on") / F.col("total")).alias("share")), "pos").alias("b"))
    judged = (
        ends.join(best, "ending", "left")
        .join(words.where("kind = 1").select(F.col("word").alias("subword"), (F.col("n") >= 2).alias("complete")), "subword", "left")
        .join(halves.withColumn("half", F.lit(True)), "subword", "left")
        .join(words.where("kind = 2 and n >= 2").select(F.col("word").alias("route"), F.lit(True).alias("route_known")), "route", "left")
    )
    half, complete = F.coalesce("half", F.lit(False)), F.coalesce("complete", F.lit(False))
    broken = (half & ~complete) | (F.col("route").isNotNull() & F.col("route_known").isNull())
    few = F.coalesce(F.col("b.words"), F.lit(0)) < 2
    return judged.select("ending", F.col("complete").isNotNull().alias("subword_complete"), (broken | F.when(few, half).otherwise(F.col("b.share") > went_on_share)).alias("cut"), (broken | few | (F.col("b.share") > 0.1)).alias("cut_at_limit"))


ENDING = "xxhash64(grams, subword, route)"


def cut_texts(documents: DataFrame, key: str = "doc_id", went_on_share: float = 0.7, seen: int = 5, salts: int = 16) -> DataFrame:
    """``key``, source and cut (boolean) of each document; null, empty and blank texts are not cut.

    Equal texts have equal answers: nothing but the text and, at lengths where its source piles up, the
    source enters, and there every copy of a text counts as cut if one does. Counts are over distinct
    texts, which are written once and read twice. The last words of a text must have been seen ``seen``
    times elsewhere, else fewer words are looked at; if fewer than two are left, half a word decides. A text
    is cut if its last words went on in more than ``went_on_share`` of their occurrences, or if another
    text goes on inside its last word, which stands nowhere as a whole word, or inside its last sentence.
    Distinct endings are judged once and joined to the texts in salted portions, so an ending that a
    third of them share makes no large task; texts are told apart by 128 bits.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("key"), "source", F.unhex(F.md5("text")).alias("text"), F.col("text").alias("content"))
    full = rows.where("content is not null and trim(content) != ''")
    texts = durable(full.select("text", "content").dropDuplicates(["text"]))
    words = corpus_words(texts)
    open_words = spark.sparkContext.broadcast(interchangeable(words))
    read = read_texts(texts, open_words)
    endings = read.where("text is not null").select("text", "decided", F.expr(ENDING).alias("ending"), F.size("grams").alias("words"))
    copies = durable(full.groupBy("source", "text").agg(F.count("*").alias("n"), F.max(F.length("content")).alias("chars"), F.max(F.octet_length("content")).alias("bytes")).join(endings.select("text", "decided"), "text"))
    limits = durable(piled_lengths(copies))
    at_limit = [copies.join(limits.where(F.col("measure") == m).select("source", F.col("length").alias(m)), ["source", m], "left_semi").select("text") for m in ("chars", "bytes")]
    piled = at_limit[0].unionByName(at_limit[1]).distinct().withColumn("piled", F.lit(True))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    verdicts = judged_endings(read, words, went_on_share, seen).withColumn("salt", salt)
    open_ends = endings.where("decided is null").withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int"))
    prefixes = strict_prefixes(texts).distinct().withColumn("prefix", F.lit(True))
    ended = open_ends.join(verdicts, ["ending", "salt"]).join(piled, "text", "left").join(prefixes, "text", "left")
    by_prefix = F.coalesce("prefix", F.lit(False)) & (~F.col("subword_complete") | (F.col("words") >= GRAMS))
    cut = F.col("cut") | (F.coalesce("piled", F.lit(False)) & F.col("cut_at_limit")) | by_prefix
    # Whatever speaks for a cut of one copy speaks for all copies of the text.
    cut_hashes = ended.where(cut).select("text").unionByName(endings.where("decided").select("text"))
    spread_out = cut_hashes.withColumn("salt", salt).withColumn("cut", F.lit(True))
    all_rows = rows.select("key", "source", "text", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"))
    return all_rows.join(spread_out, ["text", "salt"], "left").select(F.col("key").alias(key), "source", F.coalesce("cut", F.lit(False)).alias("cut"))


def cut_shares(cut: DataFrame) -> DataFrame:
    """source, documents, cut_documents and cut_share; documents without a source are a group of their own."""
    sums = cut.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut_documents"))
    return sums.withColumn("cut_share", F.col("cut_documents") / F.col("documents"))
