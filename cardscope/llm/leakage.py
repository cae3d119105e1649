"""Held-out evaluation text inside a corpus, by one Aho-Corasick automaton over the normalised items.

A passage counts when at least `min_words` successive words of an item stand in a document. The automaton does not hold every
run of that many words but anchors: blocks of `anchor_words` words at every (min_words - anchor_words + 1)-th place of an item.
Any run of min_words words contains one of them whole, so scanning for anchors misses nothing, and the automaton is about
a fourteenth the size. Around each anchor found, which is rare, the words of item and document are compared to both sides; the
run that agrees decides. A document is normalised and scanned once; places are mapped back to offsets in its own text.

A text of fewer words than that, as most answers are, proves nothing by itself. It is reported where it stands whole, within
`near_words` words of a passage of its own item.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MIN_WORDS, ANCHOR_WORDS, NEAR_WORDS = 12, 6, 40
#: Item text that one automaton holds, and automata that a Python worker keeps. The corpus is read once however many there are:
#: beyond KEPT each is made anew for every CHUNK_CHARS of documents.
BLOCK_CHARS, KEPT, CHUNK_CHARS = 4_000_000, 8, 200_000_000

_WORD = re.compile(r"[^\W_]+")
_built: dict[str, ItemAutomaton] = {}


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case."""
    return _WORD.findall(text.lower()) if text.isascii() else [w.casefold() for w in _WORD.findall(text)]


class ItemAutomaton:
    """items: (item id, field, text). Finds runs of at least min_words words of an item in a text. Texts of equal words are one."""

    def __init__(self, items: list[tuple], min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, near_words: int = NEAR_WORDS) -> None:
        if not 1 <= anchor_words <= min_words:
            raise ValueError("an anchor has between 1 and min_words words")
        self.min_words, self.anchor_words, self.near_words = min_words, anchor_words, near_words
        self.short: dict[object, list[tuple[str, list[str]]]] = {}
        owners: dict[tuple[str, ...], list[tuple]] = {}
        for i, field, text in items:
            words = words_of(text)
            if len(words) >= min_words:
                owners.setdefault(tuple(words), []).append((i, field))
            elif words:
                self.short.setdefault(i, []).append((field, words))
        self.texts, self.owners = list(owners), list(owners.values())
        places: dict[str, list[tuple[int, int]]] = {}
        for n, words in enumerate(self.texts):
            for a in range(0, len(words) - anchor_words + 1, min_words - anchor_words + 1):
                places.setdefault(f" {' '.join(words[a : a + anchor_words])} ", []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for text, where in places.items():
            self.automaton.add_word(text, (len(text), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def runs(self, text: str | None) -> list[tuple[int, int, int]]:
        """(text number, first word, words) of the longest run around each anchor, without repetition."""
        return self._runs(words_of(text), None) if text else []

    def _runs(self, words: list[str], flat: str | None) -> list[tuple[int, int, int]]:
        if self.empty or len(words) < self.min_words:
            return []
        flat = f" {' '.join(words)} " if flat is None else flat
        starts: list[int] = []
        found: dict[tuple[int, int], int] = {}
        done: dict[tuple[int, int], int] = {}  # (text, shift against the document) -> where the last run on it ends
        for last, (length, where) in self.automaton.iter(flat):
            if not starts:
                starts = [0, *accumulate(len(w) + 1 for w in words)]  # the blank before each word
            p = bisect_right(starts, last - length + 1) - 1
            for n, a in where:
                if done.get((n, p - a), -1) >= p:
                    continue
                item = self.texts[n]
                left = right = 0
                while p - left > 0 and a - left > 0 and words[p - left - 1] == item[a - left - 1]:
                    left += 1
                i, j = p + self.anchor_words, a + self.anchor_words
                while i + right < len(words) and j + right < len(item) and words[i + right] == item[j + right]:
                    right += 1
                done[(n, p - a)] = i + right - 1
                if left + self.anchor_words + right >= self.min_words:
                    found[(n, p - left)] = max(found.get((n, p - left), 0), left + self.anchor_words + right)
        return [(n, first, count) for (n, first), count in found.items()]

    def passages(self, text: str | None) -> list[tuple]:
        """(item id, field, first offset, end offset, words) in the text as given."""
        return self.passages_in(text, words_of(text)) if text else []

    def passages_in(self, text: str, words: list[str], flat: str | None = None) -> list[tuple]:
        runs = self._runs(words, flat)
        if not runs:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        out = {(i, field, spans[first][0], spans[first + count - 1][1], count) for n, first, count in runs for i, field in self.owners[n]}
        for n, first, count in runs:
            for i, _ in self.owners[n]:
                for field, short in self.short.get(i, ()):
                    low, high = max(first - self.near_words, 0), min(first + count + self.near_words, len(words))
                    out |= {(i, field, spans[k][0], spans[k + len(short) - 1][1], len(short)) for k in range(low, high - len(short) + 1) if words[k : k + len(short)] == short}
        return sorted(out, key=lambda p: p[2:])


def _automaton(name: str, items: Broadcast, options: tuple[int, int, int]) -> ItemAutomaton:
    """The automaton of a block; a Python worker keeps the KEPT latest."""
    if name not in _built:
        while len(_built) >= KEPT:
            _built.pop(next(iter(_built)))
        _built[name] = ItemAutomaton(items.value, *options)
    return _built[name]


def _blocks(items: DataFrame, id_col: str, fields: list[str], block_chars: int) -> Iterator[list[tuple]]:
    """Items in blocks of about block_chars characters; the fields of an item stay together."""
    block, size = [], 0
    for row in items.select(id_col, *fields).orderBy(id_col).toLocalIterator():
        mine = [(row[id_col], f, row[f]) for f in fields if row[f]]
        more = sum(len(m[2]) for m in mine)
        if block and size + more > block_chars:
            yield block
            block, size = [], 0
        block += mine
        size += more
    if block:
        yield block


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("item_text", "answer"),
    min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, near_words: int = NEAR_WORDS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, field, first_char, end_char, words): every passage of the items in the documents.

    Words are runs of letters and digits; case, punctuation and white space do not count. Items are read to the driver in
    blocks of about block_chars characters (or one longer item), each of which is broadcast; one scan of the documents, map-side,
    looks for all of them. Null or empty documents and items have no passages, nor has an item of fewer than min_words words. A
    field of fewer words is found whole within near_words words of a passage of its item. Equal documents and
    equal items each give their own rows; a row delivered twice gives its passages twice. Offsets count code points.
    """
    sc = documents.sparkSession.sparkContext
    doc_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType
    schema = f"`{doc_id}` {doc_type}, `{item_id}` {item_type.simpleString()}, field string, first_char int, end_char int, words int"
    texts = documents.select(F.col(doc_id), F.col(text_col)).where(F.col(text_col).isNotNull())
    arrow_type = to_arrow_type(item_type)
    blocks = [(uuid.uuid4().hex, sc.broadcast(b)) for b in _blocks(items, item_id, list(fields), block_chars)]
    if not blocks:
        return documents.sparkSession.createDataFrame([], schema)
    options, chunk_chars = (min_words, anchor_words, near_words), 0 if len(blocks) <= KEPT else CHUNK_CHARS

    def scan(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[(n, t, w, f" {' '.join(w)} ") for n, text in enumerate(batch.column(1)) if len(w := words_of(t := text.as_py())) >= min_words] for batch in batches]
        for name, block in blocks:
            automaton = _automaton(name, block, options)
            for batch, documents_ in zip(batches, read):
                rows = [(n, *p) for n, text, words, flat in documents_ for p in automaton.passages_in(text, words, flat)]
                if rows:
                    at = pa.array([r[0] for r in rows], pa.int64())
                    ids = pa.array([r[1] for r in rows], arrow_type)
                    rest = [pa.array([r[k] for r in rows], kind) for k, kind in ((2, pa.string()), (3, pa.int32()), (4, pa.int32()), (5, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), ids, *rest], [doc_id, item_id, "field", "first_char", "end_char", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.nbytes
            if size > chunk_chars:
                yield from scan(kept)
                kept, size = [], 0
        if kept:
            yield from scan(kept)

    return texts.mapInArrow(run, schema)


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", **options) -> DataFrame:
    """(doc_id, item_id): the items of which a document contains at least min_words successive words."""
    return leaked_passages(documents, items, doc_id=doc_id, item_id=item_id, **options).select(doc_id, item_id).distinct()
