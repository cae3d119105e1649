"""Flat, linked tables out of nested plan documents and nested join lists.

The documents are not walked object by object. Each batch of documents is one byte buffer over which bitmaps of quotes,
brackets and delimiters are computed; prefix sums give string membership and nesting depth; sorting by depth pairs
brackets; and the spans of objects, with the member name and the list position that lead to them, come out as arrays.
The same token arrays decide whether a document is complete JSON, by checks on neighbouring tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text indexed at once; a longer document is indexed alone.
CHUNK_BYTES = 4 << 20
_SCALAR = re.compile(rb"(?:(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)\n)*")
_OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_LIST, _CLOSE_LIST, _COMMA, _COLON, _QUOTE = b"{}[],:\""
_HALF = re.compile("[\ud800-\udfff]")
_WORD = ord("s")  # a number, true, false or null


class StructuralIndex:
    """Token arrays over a batch of documents.

    texts: documents as bytes. ok: whether each is one complete JSON value. The other attributes are arrays over the
    tokens of the good documents, in order: pos, end (exclusive), kind (a byte of `{}[],:"` or s), doc, container (index
    of the opening token around it, -1 at the top), place (position in the surrounding list), close (for opening tokens,
    the index of the closing one).
    """

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.buffer = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.buffer, dtype=np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        last = first + sizes - 1
        self.ok = np.ones(len(texts), dtype=bool)
        at = np.arange(len(buf))
        doc_of = np.repeat(np.arange(len(texts)), sizes)

        # bitmaps: an escaped byte follows an odd run of backslashes; strings lie between unescaped quotes
        plain = np.maximum.accumulate(np.where(buf != 92, at, -1))
        escaped = np.zeros(len(buf), dtype=bool)
        escaped[1:] = (at[1:] - 1 - plain[:-1]) % 2 == 1
        quotes = (buf == _QUOTE) & ~escaped
        run = np.cumsum(quotes)
        inside = (run - np.concatenate([[0], run[last[:-1]]])[doc_of]) % 2 == 1  # from the opening quote up to before the closing one
        self._bad(doc_of[last[inside[last]]])
        body = inside & ~quotes
        self._bad(doc_of[body & (buf < 32)])
        self._check_escapes(buf, body & escaped, doc_of)

        outside = ~inside & ~quotes
        structural = outside & np.isin(buf, np.frombuffer(b"{}[],:", dtype=np.uint8))
        blank = np.isin(buf, np.frombuffer(b" \t\r\n", dtype=np.uint8))
        word = outside & ~structural & ~blank
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        self._check_words(buf, word, starts, doc_of)

        pos = np.flatnonzero(structural | starts | (quotes & inside))
        kind = np.where(starts[pos], _WORD, buf[pos]).astype(np.uint8)
        end = pos + 1
        end[kind == _WORD] = np.flatnonzero(stops) + 1
        closing = np.flatnonzero(quotes & ~inside)
        strings = kind == _QUOTE
        nearest = np.minimum(np.searchsorted(closing, pos[strings]), max(len(closing) - 1, 0))
        end[strings] = closing[nearest] + 1 if len(closing) else pos[strings] + 1
        doc = doc_of[pos]

        # depth by prefix sums; documents that are not balanced go before brackets are paired
        step = np.isin(kind, [_OPEN_OBJECT, _OPEN_LIST]).astype(np.int64) - np.isin(kind, [_CLOSE_OBJECT, _CLOSE_LIST])
        total = np.cumsum(step)
        before = np.concatenate([[0], total])
        begin, stop = np.searchsorted(doc, np.arange(len(texts))), np.searchsorted(doc, np.arange(len(texts)), side="right")
        self.ok &= (before[stop] == before[begin]) & (stop > begin)
        depth = total - before[begin][doc]
        self._bad(doc[depth < 0])
        keep = self.ok[doc]
        pos, kind, end, doc, depth, step = (x[keep] for x in (pos, kind, end, doc, depth, step))
        level = depth + (step < 0)

        n, span = len(pos), int(level.max(initial=0)) + 2
        brackets = np.flatnonzero(step != 0)
        order = brackets[np.argsort(doc[brackets] * span + level[brackets], kind="stable")]
        opens, closes = order[0::2], order[1::2]
        self._bad(doc[opens[kind[opens] + 2 != kind[closes]]])  # in ASCII each closing bracket is two above its opening one
        self.close = np.full(n, -1)
        self.close[opens] = closes

        # the bracket around a token is the last one opened before it one level up
        context = level - (step != 0)
        wide = n + 1
        keys = (doc[opens] * span + level[opens]) * wide + opens
        found = np.searchsorted(keys, (doc * span + context) * wide + np.arange(n)) - 1
        self.container = np.where((found >= 0) & (context > 0), opens[np.maximum(found, 0)] if len(opens) else -1, -1)
        self._check_neighbours(kind, doc, self.container)

        commas = np.flatnonzero(kind == _COMMA)
        comma_keys = np.sort(self.container[commas] * wide + commas)
        self.place = np.searchsorted(comma_keys, self.container * wide + np.arange(n)) - np.searchsorted(comma_keys, self.container * wide)
        self.pos, self.end, self.kind, self.doc, self.buf, self.level = pos, end, kind, doc, buf, level
        self.slashes = np.concatenate([[0], np.cumsum(buf == 92)])

    def _bad(self, docs: np.ndarray) -> None:
        self.ok[docs] = False

    def _check_escapes(self, buf: np.ndarray, escapes: np.ndarray, doc_of: np.ndarray) -> None:
        at = np.flatnonzero(escapes)
        self._bad(doc_of[at[~np.isin(buf[at], np.frombuffer(b'"\\/bfnrtu', dtype=np.uint8))]])
        at = at[buf[at] == ord("u")]
        hexes = np.isin(buf, np.frombuffer(b"0123456789abcdefABCDEF", dtype=np.uint8))
        for k in range(1, 5):
            self._bad(doc_of[at[~hexes[np.minimum(at + k, len(buf) - 1)]]])

    def _check_words(self, buf: np.ndarray, word: np.ndarray, starts: np.ndarray, doc_of: np.ndarray) -> None:
        if not word.any():
            return
        chars = np.flatnonzero(word)
        breaks = np.flatnonzero(starts[chars])
        text = np.insert(buf[chars], breaks[1:], 10).tobytes() + b"\n"
        if _SCALAR.fullmatch(text):
            return
        docs = doc_of[chars[breaks]]
        self._bad(docs[[not _SCALAR.fullmatch(w + b"\n") for w in text[:-1].split(b"\n")]])

    def _check_neighbours(self, kind: np.ndarray, doc: np.ndarray, container: np.ndarray) -> None:
        if not len(kind):
            return
        prior = np.concatenate([[0], kind[:-1]])
        prior[1:][doc[1:] != doc[:-1]] = 0
        around = np.where(container >= 0, kind[np.maximum(container, 0)], 0)
        in_object = around == _OPEN_OBJECT
        name = (kind == _QUOTE) & in_object & np.isin(prior, [_OPEN_OBJECT, _COMMA])
        value = ~name & np.isin(kind, [_QUOTE, _WORD, _OPEN_OBJECT, _OPEN_LIST])
        ends = np.isin(kind, [_WORD, _CLOSE_OBJECT, _CLOSE_LIST]) | (kind == _QUOTE) & ~name
        after_value, after_name = np.concatenate([[False], ends[:-1]]) & (prior > 0), np.concatenate([[False], name[:-1]]) & (prior > 0)
        good = np.select(
            [name, value & (around == 0), value & in_object, value, kind == _COLON, kind == _COMMA],
            [True, prior == 0, prior == _COLON, np.isin(prior, [_OPEN_LIST, _COMMA]), after_name & in_object, after_value & (around > 0)],
            after_value | (prior + 2 == kind),
        )
        self._bad(doc[~good])

    def text(self, token: int) -> str:
        """The string of a token, decoded, or the raw text of any other value. Half a surrogate pair becomes U+FFFD."""
        raw = self.buffer[self.pos[token] : self.end[token if self.close[token] < 0 else self.close[token]]]
        if self.kind[token] == _QUOTE:
            return _HALF.sub("\ufffd", json.loads(raw)) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")
        return raw.decode("utf-8", "replace")

    def strings(self, tokens: np.ndarray) -> pa.Array:
        """`text` of many tokens, cut out of the buffer at once; only strings with escapes are decoded one by one."""
        quoted = (self.kind[tokens] == _QUOTE).astype(np.int64)
        starts = self.pos[tokens] + quoted
        stops = self.end[np.where(self.close[tokens] < 0, tokens, self.close[tokens])] - quoted
        sizes = stops - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32 if sizes.sum() < 2**31 else np.int64)
        data = self.buf[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
        kind = pa.StringArray if offsets.dtype == np.int32 else pa.LargeStringArray
        out = kind.from_buffers(len(tokens), pa.py_buffer(offsets), pa.py_buffer(data))
        escaped = (self.slashes[stops] > self.slashes[starts]) & (quoted == 1)
        if escaped.any():
            out = pc.replace_with_mask(out, pa.array(escaped), pa.array([self.text(t) for t in tokens[escaped]], out.type))
        return out.cast(pa.string())

    def named(self, tokens: np.ndarray, name: str) -> np.ndarray:
        """Those of the tokens that are values of a member with this name."""
        tokens = tokens[tokens >= 2]
        tokens = tokens[(self.kind[tokens - 1] == _COLON) & (self.kind[tokens - 2] == _QUOTE)]
        keys, raw = tokens - 2, name.encode()
        length = self.end[keys] - self.pos[keys] - 2
        same = length == len(raw)
        for k, b in enumerate(raw):
            same &= self.buf[np.minimum(self.pos[keys] + 1 + k, len(self.buf) - 1)] == b
        # a longer key may be the same name with escapes
        for i in np.flatnonzero((length > len(raw)) & (self.slashes[self.end[keys]] > self.slashes[self.pos[keys]])):
            same[i] = self.text(keys[i]) == name
        return tokens[same]

    def values(self) -> np.ndarray:
        """The tokens of good documents that are values of members of objects."""
        tokens = np.flatnonzero(self.ok[self.doc] & np.isin(self.kind, [_QUOTE, _WORD, _OPEN_OBJECT, _OPEN_LIST]))
        tokens = tokens[tokens >= 2]
        return tokens[self.kind[tokens - 1] == _COLON]


def layers(texts: list[bytes]) -> Iterator[tuple[StructuralIndex, np.ndarray]]:
    """(index, number of each of its documents) of the documents, then of those that stand inside their strings, and so on."""
    numbers = np.arange(len(texts))
    while len(numbers):
        index = StructuralIndex(texts)
        yield index, numbers
        opened = np.cumsum((index.kind == _OPEN_OBJECT).astype(np.int64) - (index.kind == _CLOSE_OBJECT))
        before = np.concatenate([[0], opened])[np.searchsorted(index.doc, index.doc)]
        tops = np.flatnonzero(index.ok[index.doc] & (index.kind == _QUOTE) & (opened == before))  # in no object, maybe in lists
        texts, numbers = [index.text(t).encode("utf-8", "replace") for t in tops], numbers[index.doc[tops]]


def _spread(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which key, place in sorted_keys) of every match."""
    low, high = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, side="right")
    which = np.repeat(np.arange(len(keys)), high - low)
    first = np.cumsum(high - low) - (high - low)
    return which, np.arange(len(which)) - first[which] + low[which]


class PlanTree:
    """The plan nodes and workers of the documents of an index, as arrays: token (of the object), worker, path and parent.

    The root of a document is its least deep object `Plan`, the first of equally deep ones. Levels are made one after the other,
    each as a whole: the members of a level's lists are found by search in arrays, and their paths by joining columns of text.
    """

    def __init__(self, index: StructuralIndex, skip: np.ndarray | None = None) -> None:
        live = index.ok[index.doc]
        if skip is not None:
            live &= ~skip[index.doc]
        objects, lists = (np.flatnonzero(live & (index.kind == k)) for k in (_OPEN_OBJECT, _OPEN_LIST))
        roots = index.named(objects, "Plan")
        roots = roots[np.lexsort((roots, index.level[roots], index.doc[roots]))]
        roots = roots[np.unique(index.doc[roots], return_index=True)[1]]
        members = {}
        for name in ("Plans", "Workers"):
            inside = objects[np.isin(index.container[objects], index.named(lists, name))]
            owner = index.container[index.container[inside]]
            order = np.argsort(owner, kind="stable")
            members[name] = (inside[order], owner[order])
        self.index, self.roots = index, roots
        tokens, workers, paths, parents = [], [], [], []
        level, path, parent = roots, pa.array(["0"] * len(roots), pa.string()), pa.array([""] * len(roots), pa.string())
        while len(level):
            tokens.append(level), workers.append(np.zeros(len(level), dtype=bool)), paths.append(path), parents.append(parent)
            below = {}
            for name, mark in (("Workers", ".w"), ("Plans", ".")):
                found, owners = members[name]
                which, at = _spread(level, owners)
                place = pa.array(index.place[found[at]]).cast(pa.string())
                up = path.take(pa.array(which))
                below[name] = (found[at], pc.binary_join_element_wise(up, place, mark), up)
            token, at_path, up = below["Workers"]
            tokens.append(token), workers.append(np.ones(len(token), dtype=bool)), paths.append(at_path), parents.append(up)
            level, path, parent = below["Plans"]
        self.token = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        self.worker = np.concatenate(workers) if workers else np.zeros(0, bool)
        text = lambda parts: pa.concat_arrays([x.cast(pa.string()) for x in parts]) if parts else pa.array([], pa.string())
        self.path, self.parent = text(paths), text(parents)
        self.doc = index.doc[self.token]

    def attributes(self) -> pa.Array:
        """For each record its members other than Plans and Workers as a map of text: strings decoded, anything else as written. Of
        members named alike the last stands."""
        index, values = self.index, self.index.values()
        keys = index.strings(values - 2)
        coded = keys.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lists = [i for i, k in enumerate(coded.dictionary.to_pylist()) if k in ("Plans", "Workers")]
        owner = index.container[values]
        last = len(values) - 1 - np.unique((owner * (len(coded.dictionary) + 1) + code)[::-1], return_index=True)[1]
        at = np.sort(last)[~np.isin(code[np.sort(last)], lists)]
        at = at[np.argsort(owner[at], kind="stable")]
        which, place = _spread(self.token, owner[at])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(self.token)))])
        chosen = pa.array(at[place])
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), keys.take(chosen), index.strings(values).take(chosen))


def plan_trees(texts: list[bytes]) -> Iterator[tuple[PlanTree, np.ndarray]]:
    """(tree, number of each of its documents) over the layers of documents; a document found in one layer is not looked for in
    the strings of the next."""
    seen = np.zeros(len(texts), dtype=bool)
    for index, numbers in layers(texts):
        tree = PlanTree(index, seen[numbers])
        seen[numbers[index.doc[tree.roots]]] = True
        yield tree, numbers


def plan_records(texts: list[bytes]) -> list[tuple[int, str, str, str]]:
    """(document, record kind, path, parent path) of the plan nodes and workers of each document."""
    out: list[tuple[int, str, str, str]] = []
    for tree, numbers in plan_trees(texts):
        kinds = ["worker" if w else "node" for w in tree.worker]
        out += zip(numbers[tree.doc].tolist(), kinds, tree.path.to_pylist(), tree.parent.to_pylist())
    return out


def chunks(ids: list, texts: list) -> Iterator[tuple[list, list[bytes]]]:
    keys: list = []
    docs: list[bytes] = []
    size = 0
    for key, text in zip(ids, texts):
        if text is None:
            continue
        raw = text.encode("utf-8", "replace")
        if docs and size + len(raw) > CHUNK_BYTES:
            yield keys, docs
            keys, docs, size = [], [], 0
        keys.append(key)
        docs.append(raw)
        size += len(raw)
    if docs:
        yield keys, docs


def plan_tables(df: DataFrame, id_col: str, document_col: str, attributes: bool = False) -> DataFrame:
    """One row per plan node and per worker of each document: (id, record_kind, path, parent_path[, attributes]).

    The object `Plan` has path 0 and parent ''; position i of a node's `Plans` has path `<parent>.i`, position i of its
    `Workers` `<node>.wi`. Positions count every list element; elements that are not objects give no row. A wrapping
    list, object or string makes no difference. A document that is null, empty or not complete JSON, or has no Plan, gives
    no row. A null id stays null. Rows delivered twice come out once. Other columns of df are neither read nor returned.
    Map-side only, apart from the distinct over the (short) result rows.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, record_kind string, path string, parent_path string" + ", attributes map<string,string>" * attributes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for keys, docs in chunks(list(range(len(texts))), texts):
                for tree, numbers in plan_trees(docs):
                    at = pa.array(np.array(keys, dtype=np.int64)[numbers[tree.doc]])
                    kind = pc.if_else(pa.array(tree.worker), "worker", "node")
                    cols, names = [ids.take(at), kind, tree.path, tree.parent], ["id", "record_kind", "path", "parent_path"]
                    if attributes:
                        cols, names = [*cols, tree.attributes()], [*names, "attributes"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    found = df.select(F.col(id_col).alias("id"), F.col(document_col).alias("document")).where(F.col("document").isNotNull()).mapInArrow(run, schema)
    return found.dropDuplicates(["id", "record_kind", "path"]).withColumnRenamed("id", id_col)


def join_tables(df: DataFrame, id_col: str, joins_col: str) -> tuple[DataFrame, DataFrame]:
    """The joins and the joined relations of a list of join structs, as two flat tables that name id and parent.

    Joins: (id, path `ji`, parent_path '', every member of the struct that is not a list). Relations: (id, path `ji.b.k`,
    parent_path `ji`, branch, place, relation). Null lists and null elements give no row but count as positions.
    Rows delivered twice come out once.
    """
    exploded = df.select(id_col, F.posexplode(joins_col).alias("i", "j")).where(F.col("j").isNotNull())
    flat = [f.name for f in exploded.schema["j"].dataType.fields if f.dataType.typeName() != "array"]
    joins = exploded.select(id_col, F.concat(F.lit("j"), "i").alias("path"), F.lit("").alias("parent_path"), *(F.col("j")[c].alias(c) for c in flat))
    branches = exploded.select(id_col, "i", F.posexplode(F.col("j.branch_relations")).alias("branch", "members"))
    relations = branches.select(id_col, "i", "branch", F.posexplode("members").alias("place", "relation")).where(F.col("relation").isNotNull())
    parent = F.concat(F.lit("j"), "i")
    relations = relations.select(id_col, F.concat_ws(".", parent, "branch", "place").alias("path"), parent.alias("parent_path"), "branch", "place", "relation")
    return joins.dropDuplicates([id_col, "path"]), relations.dropDuplicates([id_col, "path"])


def linked_records(df: DataFrame, id_col: str, document_col: str, joins_col: str) -> DataFrame:
    """Nodes, workers, joins and relations in one table (id, record_kind, path, parent_path)."""
    joins, relations = join_tables(df, id_col, joins_col)
    cols = [id_col, "record_kind", "path", "parent_path"]
    return (
        plan_tables(df, id_col, document_col).select(cols)
        .unionByName(joins.withColumn("record_kind", F.lit("join")).select(cols))
        .unionByName(relations.withColumn("record_kind", F.lit("relation")).select(cols))
    )
