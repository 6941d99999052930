"""Evaluation texts in a corpus, found by template windows with typed slots.

Words are canonicalised: numbers, names and units become placeholders, all others stay. A template is a window of k
canonical words in a row. Templates of the items are joined by hash with those of the documents; a join partner is an
exact leak if the words themselves are equal, and a re-parameterised one if the placeholders are filled consistently: one
value of the item always stands for the same value in the document.

A number is a word that begins with a digit or another numeric character, or a number word of one of the languages given. A
unit is whatever follows a number, so no list of units is needed; the first word of a window has nothing before it and is
none. A name is a word that items capitalise within a sentence, and never write small; a language that capitalises other
words too has more slots, and the check of consistency decides. The type of a word in a window depends on nothing but the
window's lower-case words and the items' words, so equal passages always have equal templates.

Documents are cut into words as vectors of code points, and only windows all of whose words can occur in a template leave
the scan. That reduction is exact. Its vocabulary, the distinct words of the held-out items, is the same however many items
there are; many items are only counted where they lie.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm.tokens import WORD, classes, code_points
from triloom.session import arrow, col

#: Number words by language, without those that are common as other words.
NUMBERS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split(),
    "de": "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend".split(),
    "fr": "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille".split(),
    "es": "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil".split(),
}
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Characters of all items up to which the driver reads them itself to list their words; beyond, tasks do.
MAX_VOCABULARY_CHARS = 4_000_000
#: Characters of all items up to which their templates, at most one for two characters, are broadcast.
MAX_BROADCAST_CHARS = 400_000


def words_of(text: str, opens: bool = True) -> list[tuple[str, bool | None]]:
    """The words of ``text`` in lower case, and whether they were capitalised; None where a sentence starts with a capital, which says nothing.

    ``opens``: a sentence begins where ``text`` does.
    """
    starts, ends = _spans(classes()[code_points(text)])
    out = []
    for i, (a, b) in enumerate(zip(starts, ends)):
        stop = _stops(text[ends[i - 1] : a]) if i else opens
        out += [(w, (None if stop else True) if text[a].isupper() else False) for w in _lower(text[a:b])]
    return out


def _stops(gap: str) -> bool:
    return any(c in gap for c in ".!?\n:")


def _spans(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    on = np.diff((kind == WORD).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(on == 1), np.flatnonzero(on == -1)


def _lower(word: str) -> list[str]:
    low = word.lower()
    if low.isalnum():
        return [low]
    starts, ends = _spans(classes()[code_points(low)])  # a few letters become a letter and a mark
    return [low[a:b] for a, b in zip(starts, ends)]


def is_number(word: str, numbers: frozenset[str]) -> bool:
    return word[0].isnumeric() or word in numbers


def vocabulary(items: list[str], numbers: frozenset[str]) -> dict[str, str]:
    """The canonical form of every word of the items, by itself. A name is a word that is capitalised within a sentence, and never small."""
    capital: dict[str, bool | None] = {}
    for text in items:
        _add(capital, words_of(text))
    return _canonical(capital, numbers)


def _add(capital: dict[str, bool | None], words: list[tuple[str, bool | None]]) -> None:
    for w, up in words:
        if w not in capital or capital[w] is None or up is False:
            capital[w] = up


def _canonical(capital: dict[str, bool | None], numbers: frozenset[str]) -> dict[str, str]:
    return {w: NUM if is_number(w, numbers) else NAME if up else w for w, up in capital.items()}


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        capital: dict[str, bool | None] = {}
        for text in batch.column(0).to_pylist():
            _add(capital, words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(capital), pa.string()), pa.array(list(capital.values()), pa.bool_())], ["word", "up"])


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, languages: tuple[str, ...] = tuple(NUMBERS), number_words: tuple[str, ...] = ()) -> DataFrame:
    """Documents that hold ``window`` consecutive words of an item, as they are or with other numbers, names and units.

    Columns: doc_id, item_id, n_exact and n_changed (distinct templates of the item that match with equal words, or with
    consistent other slot values), kind (``exact`` if any matches exactly, else ``changed``). Words are maximal runs of
    letters and digits in lower case; what stands between them is ignored. Null and empty texts, and items shorter than
    the window, match nothing. Repeated rows of a document or item count once. ``languages`` choose among NUMBERS,
    ``number_words`` adds words (in lower case) of others.
    """
    numbers = frozenset(number_words).union(*(NUMBERS[x] for x in languages))
    own = items.select(col(items, item_id).alias("item_id"), col(items, item_text).alias("text")).where("text is not null")
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars <= MAX_VOCABULARY_CHARS:
        vocab = vocabulary([r.text for r in own.select("text").collect()], numbers)
    else:
        listed = own.select("text").transform(arrow, _item_words, "word string, up boolean").groupBy("word").agg(F.min("up").alias("up"))
        vocab = _canonical({r.word: r.up for r in listed.collect()}, numbers)
    schema = "id {}, template string, words string"
    wanted = own.transform(arrow, _windows(vocab, window, numbers), schema.format(dict(own.dtypes)["item_id"])).select(F.col("id").alias("item_id"), "template", F.col("words").alias("item_words")).distinct()
    body = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text")).where(F.length("text") > window)
    found = body.transform(arrow, _windows(vocab, window, numbers), schema.format(dict(body.dtypes)["doc_id"])).select(F.col("id").alias("doc_id"), "template", "words")
    if chars <= MAX_BROADCAST_CHARS:
        wanted = F.broadcast(wanted)
    pairs = found.join(wanted, "template")
    exact = F.col("words") == F.col("item_words")
    slots = F.arrays_zip(F.split("item_words", " "), F.split("words", " "))
    consistent = F.size(F.array_distinct(slots)) == F.size(F.array_distinct(F.split("item_words", " ")))
    judged = pairs.select("doc_id", "item_id", "template", F.when(exact, 1).when(consistent, 2).otherwise(0).alias("how")).where("how > 0")
    each = judged.groupBy("doc_id", "item_id", "template").agg(F.min("how").alias("how"))
    return each.groupBy("doc_id", "item_id").agg(F.count_if(F.col("how") == 1).alias("n_exact"), F.count_if(F.col("how") == 2).alias("n_changed")).withColumn("kind", F.when(F.col("n_exact") > 0, "exact").otherwise("changed"))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)]), np.cumprod(np.r_[np.uint64(1), np.full(n, inverse)])


def _hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    up, _ = _powers(max(map(len, words)))
    return np.unique(np.array([np.sum(code_points(w).astype(np.uint64) * up[: len(w)]) for w in words], np.uint64))


def _in(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _windows(vocab: dict[str, str], k: int, numbers: frozenset[str]):
    """(id, template, words) of every window of k words that can match; each distinct one of a text once."""
    known, counted = (_hashes(sorted(x)) for x in ({*vocab, *numbers} if vocab else (), numbers))

    def canon(w: str, capital: bool | None) -> str:
        if (c := vocab.get(w)) is not None:
            return c
        return NUM if is_number(w, numbers) else "" if capital is False else NAME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            templates: list[str] = []
            literals: list[str] = []
            for owners, texts in _pieces(batch.column(1).to_pylist(), k):
                for i, stretch, opens in _stretches(texts, known, counted, k):
                    ws = words_of(stretch, opens)
                    alone = [canon(*w) for w in ws]
                    within = [UNIT if j and alone[j - 1] == NUM and c != NUM else c for j, c in enumerate(alone)]
                    seen = set()
                    gap = -1  # the last word that is in no template
                    for j, c in enumerate(within):
                        if not c:
                            gap = j
                        if j - gap >= k and alone[first := j - k + 1]:
                            pair = (" ".join([alone[first], *within[first + 1 : j + 1]]), " ".join(w for w, _ in ws[first : j + 1]))
                            if pair not in seen:
                                seen.add(pair)
                                at.append(owners[i])
                                templates.append(pair[0])
                                literals.append(pair[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(templates, pa.string()), pa.array(literals, pa.string())], ["id", "template", "words"])

    return run


#: Characters that are looked at together, so that vectors stay small.
SLICE = 2_000_000


def _pieces(texts: list[str | None], k: int) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, with their places, in groups of a few million characters; longer ones in parts that share k - 1 words."""
    owners: list[int] = []
    held: list[str] = []
    n = 0
    for i, t in enumerate(texts):
        for part in _parts(t or "", k):
            owners.append(i)
            held.append(part)
            n += len(part)
            if n > SLICE:
                yield owners, held
                owners, held, n = [], [], 0
    if held:
        yield owners, held


def _parts(text: str, k: int) -> Iterator[str]:
    """Parts that end at word ends, each from the start of the (k - 1)-th word before the last part's end, so no k words are torn."""
    start = end = 0
    while len(text) - end > SLICE:
        end += SLICE
        while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
        yield text[start:end]
        start, words = end, 0
        while start and words < k - 1:
            start -= 1
            words += text[start].isalnum() and not (start and text[start - 1].isalnum())
    yield text[start:]


def _stretches(texts: list[str], known: np.ndarray, counted: np.ndarray, k: int) -> Iterator[tuple[int, str, bool]]:
    """(text, part of it, whether it opens a sentence) for every part that has k or more words in a row that may be in a template."""
    odd = {i for i, t in enumerate(texts) if len(t.lower()) != len(t)}  # a letter becomes two: these few are taken whole
    yield from ((i, texts[i], True) for i in odd)
    texts = [t if i not in odd else "" for i, t in enumerate(texts)]
    whole = "\n".join(texts)
    points, raw = code_points(whole.lower()).astype(np.int64), code_points(whole)
    starts, ends = _spans(classes()[points])
    if not len(starts) or not len(known):
        return
    up, down = _powers(len(points))
    sums = np.r_[np.uint64(0), np.cumsum(points.astype(np.uint64) * up[:-1])]
    hashes = (sums[ends] - sums[starts]) * down[starts]
    may = _in(hashes, known)
    may |= raw[starts] != points[starts]  # capitalised: may fill the slot of a name
    number = _numeric()[points[starts]] | _in(hashes, counted)
    may |= number
    may[1:] |= number[:-1]  # may fill the slot of a unit
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    on = np.flatnonzero(np.diff(may.astype(np.int8), prepend=0, append=0))
    for a, b in zip(on[::2], on[1::2]):
        if b - a < k:
            continue
        cuts = a + 1 + np.flatnonzero(np.diff(owner[a:b]))
        for x, y in zip(np.r_[a, cuts], np.r_[cuts, b]):
            if y - x >= k:
                before = x and owner[x - 1] == owner[x]
                yield int(owner[x]), whole[starts[x] : ends[y - 1]], _stops(whole[ends[x - 1] : starts[x]]) if before else True


@functools.cache
def _numeric() -> np.ndarray:
    return np.array([chr(i).isnumeric() for i in range(sys.maxunicode + 1)])
