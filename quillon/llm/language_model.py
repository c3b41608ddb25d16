"""LM scoring: an interpolated modified Kneser-Ney model of n-grams, counted in Spark and memory-mapped by the workers.

Counting: every task counts the grams of its texts (``order`` words each, the begin mark before the first ones), deals them out
by a hash of the gram, and the receivers sum them.  A receiver writes its share as a sorted array of gram hashes with their
counts, and passes on what the shorter grams had there: the words before the last as context (tokens, successors seen once,
twice, more often), the words behind the first as successor (tokens, distinct words before).  A further exchange for each
shorter length sums these into sorted arrays in the same way, down to single words.  Hot words and grams are spread over all
shards of the longer grams and summed there first, so no exchange gathers the rows of a word.  A shard stands for some
``SHARD_BYTES`` of text at any size of the corpus; beyond 1 << ``TASK_BITS`` shards a task takes several, one after the other, and
writes them to one file.  Rows of an exchange are made for tasks, not for shards, so that they hold many grams at any size; a task of
several shards cuts what it gets into their rows and sorts these.  Only the counts of counts, a row a task and length, reach the driver.

Scoring: a worker maps the arrays from the shared folder and looks up sorted queries of a slice of texts at a time:
p(w | v) = max(a - D(a), 0) / T(v) + g(v) p(w | v without its first word), p(w) = max(b - d(b), 0) / B + g / (V + 1), with v
the words before, a the gram's count (for less than ``order`` words: how many words it follows), T(v) the sum of a over what
follows v, b the distinct predecessors of w, B all distinct pairs, V the distinct tokens.  Discounts D and d for one, two, three
and more come from the counts of counts of their length.  An unknown word has the uniform share alone.

The query's order is ``ORDER``; the README has the figures of order three.

Edge cases: a null, empty or blank text is its end token alone; rows that repeat are counted and scored one by one; a null id
belongs to the training part; without any training token the base and the model are uniform over one unknown word; an
empty table gives no rows; a text of any length is counted and scored whole, a slice of its own in its task; other columns are not
read.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, lowered, mix64, open_store, prefix_hash, shared_folder, slices, span_hash, word_spans

ORDER = 2
FOLDS = 5
HELD_OUT = 1
SHARD_BYTES = 16 << 20
TASK_BITS = 12
MOST_MAPPED, MOST_READ = 4096, 64
FLUSH_TOKENS = 2_000_000
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
FULL = 255


def columns_of(length: int, order: int) -> tuple:
    """What the array of the grams of a length holds: names and types."""
    if length == order:
        return (("a", np.uint8),)
    tokens_of_words = (("c", np.uint64),) if length == 1 else ()
    return ("t", np.uint64), *tokens_of_words, ("n1", np.uint64), ("n2", np.uint64), ("n3", np.uint64), ("b", np.uint64)


def gram_keys(words: list[np.ndarray]) -> np.ndarray:
    """A hash for each gram, given its first words, second words and so on."""
    keys = words[0]
    for after in words[1:]:
        keys = mix64(mix64(keys) * np.uint64(0x2545F4914F6CDD1D) + after)
    return keys


def tokens(buf: np.ndarray, offsets: np.ndarray, order: int):
    """Token hashes of a slice, end tokens included, behind those of the order - 1 tokens before each; and where each text's tokens begin."""
    low = lowered(buf)
    starts, ends, first = word_spans(low, offsets)
    words = span_hash(prefix_hash(low), starts, ends)
    begins = first + np.arange(len(first))
    out = np.full(len(words) + len(offsets) - 1, END)
    counts = np.diff(first)
    out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    grams = [out]
    for _ in range(order - 1):
        before = np.empty_like(out)
        before[1:] = grams[0][:-1]
        before[begins[:-1]] = BEGIN
        grams.insert(0, before)
    return grams, begins


def summed(words: list[np.ndarray], columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Keys of the distinct grams in ascending order, their words, and the sums of the columns."""
    keys = gram_keys(words)
    by = np.argsort(keys)
    keys = keys[by]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    pick = by[at]
    return keys[at], [w[pick] for w in words], [np.add.reduceat(c[by], at) if len(at) else c[:0] for c in columns]


def shorter(words: list[np.ndarray], value: np.ndarray, c: np.ndarray):
    """From distinct grams with their counts (or numbers of words before) and tokens: the grams without the last word and those without
    the first, not yet summed: their words, then the columns t, c, n1, n2, n3, b."""
    real = value > 0
    words, value, c = [w[real] for w in words], value[real], c[real]
    _, context, (t, *n) = summed(words[:-1], [value, *((x).astype(np.uint64) for x in (value == 1, value == 2, value > 2))])
    _, behind, (c, b) = summed(words[1:], [c, np.ones(len(value), dtype=np.uint64)])
    none_c, none_b = np.zeros(len(t), np.uint64), np.zeros(len(b), np.uint64)
    columns = [np.concatenate(x) for x in ((t, none_b), (none_c, c), *((x, none_b) for x in n), (none_c, b))]
    return [*(np.concatenate(x) for x in zip(context, behind, strict=True)), *columns]


def pooled(chunks, words: int, most: int, pack):
    """Rows of the sums of chunks (arrays, the words first), made whenever ``most`` grams are held."""
    held, size = [], 0

    def packed():
        arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
        return pack(*summed(arrays[:words], arrays[words:]))

    for arrays in chunks:
        held.append(arrays)
        size += len(arrays[0])
        if size >= most:
            yield packed()
            held, size = [], 0
    if size:
        yield packed()


def gram_rows(keys: np.ndarray, words: list[np.ndarray], n: np.ndarray, bits: int, kind: type) -> pa.RecordBatch:
    """A row for each part (the first ``bits`` of the keys): the first word as distinct values with run lengths, other words, counts."""
    shift = np.uint64(64 - bits)
    part = keys >> shift
    by = np.argsort((part << shift) | (words[0] >> np.uint64(bits)))
    (first, *others), n, part = [w[by] for w in words], n[by].astype(kind), part[by]
    edge = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (part[1:] != part[:-1])]))
    runs = _blobs(part[edge], [first[edge], np.diff(np.append(edge, len(first))).astype(np.uint32)])
    columns = [*runs.columns, *_blobs(part, [*others, n]).columns[1:]]
    return pa.RecordBatch.from_arrays(columns, names=["part", *(f"x{i}" for i in range(len(columns) - 1))])


def shorter_rows(keys: np.ndarray, words: list[np.ndarray], columns: list[np.ndarray], bits: int, kind: type) -> pa.RecordBatch:
    """A row for each part: words and columns; ``sizes`` is null."""
    out = _blobs(keys >> np.uint64(64 - bits), [*words, *(x.astype(kind) if k > 1 else x for k, x in enumerate(columns))])
    return pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary())], names=[*out.schema.names, "sizes"])


class ShardFile:
    """The shards of a task, one behind the other in a file, each begun at a multiple of 8 bytes: a sorted array of hashes, then a column
    for each value; behind a column of bytes the places and values (64 bits) of those from FULL on.  At the end the shards' numbers, places
    and lengths, and how many shards there are.  Written under another name and then moved, as by ``publish``."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.sink, self.rows = folder, name, None, []

    def add(self, part: int, task: int, keys: np.ndarray, columns: list[tuple[np.ndarray, type]]) -> None:
        if self.sink is None:
            self.store, self.path = open_store(f"{self.folder}/{self.name}-{task:05d}")
            self.store.create_dir(os.path.dirname(self.path), recursive=True)
            self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
            self.sink = self.store.open_output_stream(self.draft)
        self.rows.append((part, self.sink.tell(), len(keys)))
        self.sink.write(np.ascontiguousarray(keys).tobytes())
        for values, kind in columns:
            self.sink.write(np.minimum(values, np.iinfo(kind).max).astype(kind).tobytes())
            if kind is np.uint8:
                large = np.flatnonzero(values >= FULL)
                self.sink.write(np.stack([large, values[large]]).astype(np.uint64).tobytes())
        self.sink.write(bytes(-self.sink.tell() % 8))

    def close(self) -> None:
        if self.sink is not None:
            self.sink.write(np.array([x for row in self.rows for x in row] + [len(self.rows)], dtype=np.int64).tobytes())
            self.sink.close()
            self.store.move(self.draft, self.path)


class Table:
    """The shards of sorted hashes of one kind, mapped when first asked for.  tasks: the numbers of the files there are."""

    def __init__(self, folder: str, name: str, tasks: set[int], bits: int, task_bits: int, columns):
        self.folder, self.name, self.tasks, self.bits, self.shift, self.columns = folder, name, tasks, bits, bits - task_bits, columns
        self.files: dict[int, tuple] = {}
        self.open: dict[int, tuple[np.ndarray, list[np.ndarray], np.ndarray]] = {}

    def file(self, task: int):
        """A file, whether it is mapped, and its shards' numbers, places, lengths and ends."""
        if task not in self.files:
            from pyarrow import fs

            store, path = open_store(f"{self.folder}/{self.name}-{task:05d}")
            local = isinstance(store, fs.LocalFileSystem)
            source = pa.memory_map(path) if local else store.open_input_file(path)
            count = int(np.frombuffer(source.read_at(8, source.size() - 8), dtype=np.int64)[0])
            foot = source.size() - 8 - 24 * count
            part, at, n = np.frombuffer(source.read_at(24 * count, foot), dtype=np.int64).reshape(-1, 3).T
            self.files[task] = source, local, part, at, n, np.append(at[1:], foot)
        return self.files[task]

    def shard(self, number: int):
        """A shard's hashes, its columns, and the places and values of its large counts; None where it has no grams."""
        if number in self.open:
            return self.open[number]
        task = number >> self.shift
        if task not in self.tasks:
            return None
        source, local, parts, begins, lengths, ends = self.file(task)
        k = int(np.searchsorted(parts, number))
        if k == len(parts) or parts[k] != number:
            return None
        while len(self.open) >= (MOST_MAPPED if local else MOST_READ):
            self.open.pop(next(iter(self.open)))
        source.seek(int(begins[k]))
        raw, n = source.read_buffer(int(ends[k] - begins[k])), int(lengths[k])
        at, values, large = 8 * n, [], np.zeros((2, 0), np.uint64)
        for _, kind in self.columns:
            values.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
        if self.columns[-1][1] is np.uint8:
            large = np.frombuffer(raw, dtype=np.uint64, count=2 * ((raw.size - at) // 16), offset=at).reshape(2, -1)
        self.open[number] = np.frombuffer(raw, dtype=np.uint64, count=n), values, large
        return self.open[number]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The columns' values for any keys; 0 where a key isn't there."""
        unique, inverse = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(unique), dtype=np.int64) for _ in self.columns]
        part = (unique >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        for s, e in zip(at, np.append(at[1:], len(unique)) if len(part) else [], strict=True):
            shard = self.shard(int(part[s]))
            if shard is None:
                continue
            known, values, (large, whole) = shard
            place = np.minimum(np.searchsorted(known, unique[s:e]), len(known) - 1)
            hit = known[place] == unique[s:e]
            for column, v in zip(out, values, strict=True):
                column[s:e] = np.where(hit, v[place], 0)
                if v.dtype == np.uint8:
                    full = np.flatnonzero(column[s:e] == FULL)
                    column[s + full] = whole[np.searchsorted(large, place[full])]
        return [c[inverse] for c in out]


def _blobs(part: np.ndarray, arrays: list[np.ndarray]):
    """Rows (part, one binary for each array) from arrays sorted by part."""
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    stop = np.append(at[1:], len(part))
    cells = [pa.array([x[s:e].tobytes() for s, e in zip(at.tolist(), stop.tolist(), strict=True)], pa.binary()) for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), *cells], names=["part", *(f"x{i}" for i in range(len(cells)))])


def _whole(batch, kinds) -> list[np.ndarray]:
    """The arrays of all rows of a batch end to end."""
    return [np.frombuffer(b"".join(x.to_pylist()), dtype=kind) for x, kind in zip(batch.columns[1:], kinds, strict=False)]


def _parts(batches, kinds):
    """From batches sorted by part: part and its arrays end to end."""
    part, held = None, [[] for _ in kinds]
    for batch in batches:
        for k, p in enumerate(batch.column(0).to_pylist()):
            if part is not None and p != part:
                yield part, [np.concatenate(x) for x in held]
                held = [[] for _ in kinds]
            part = p
            for x, column, kind in zip(held, batch.columns[1:], kinds, strict=True):
                x.append(np.frombuffer(column[k].as_buffer(), dtype=kind))
    if part is not None:
        yield part, [np.concatenate(x) for x in held]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For one, two, three and more, from the numbers of things counted once to four times; halves where these are missing."""
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * after / here, 0.05), k - 0.05) for k, here, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Model:
    """What scoring needs; small but for the mapped arrays.  tasks: for each length the numbers of the files; totals: for each length
    the sums of ``Sizes``."""

    def __init__(self, folder: str, bits: int, task_bits: int, order: int, tasks: dict[int, set[int]], totals: dict[int, list[int]]):
        self.order = order
        self.tables = {k: Table(folder, f"grams{k}", tasks[k], bits, task_bits, columns_of(k, order)) for k in tasks}
        self.n, self.v, types = totals[1][:3]
        self.types = max(types, 1)
        self.discount = {k: np.array([0.0, *discounts(*x[3:7])]) for k, x in totals.items()}
        d, (m1, m2, m3, _, more) = self.discount[1], totals[1][3:]
        self.rest = ((d[1] * m1 + d[2] * m2 + d[3] * (m3 + more)) / types if types else 1.0) / (self.v + 1)

    def probability(self, grams: list[np.ndarray]):
        """p(last word | the words before it) and the last words' counts."""
        n = len(grams[-1])
        p = known = behind = None
        for k in range(1, self.order + 1):
            own = gram_keys(grams[self.order - k :])
            asked = own if k == self.order else np.concatenate([gram_keys(grams[self.order - 1 - k : -1]), own])
            found = dict(zip((name for name, _ in columns_of(k, self.order)), self.tables[k].find(asked), strict=True))
            value, d = found["a" if k == self.order else "b"][-n:] if n else np.zeros(0, np.int64), self.discount[k]
            above = np.maximum(value - d[np.minimum(value, 3)], 0)
            if k == 1:
                p, known = above / self.types + self.rest, found["c"][n:]
            else:
                whole = np.maximum(behind["t"], 1)
                left = (d[1] * behind["n1"] + d[2] * behind["n2"] + d[3] * behind["n3"]) / whole
                p = np.where(behind["t"] > 0, above / whole + left * p, p)
            behind = {name: x[:n] for name, x in found.items()}
        return p, known


class Sizes:
    """What a task's shards of a length sum up to: tokens, distinct tokens, sum of the values, values of 1, 2, 3, 4, above 3."""

    def __init__(self, length: int):
        self.length, self.task, self.sums = length, None, np.zeros(8, np.int64)

    def add(self, task: int, c: np.ndarray, value: np.ndarray) -> None:
        self.task = task
        self.sums += np.array([c.sum(), (c > 0).sum(), value.sum(), *((value == k).sum() for k in (1, 2, 3, 4)), (value > 3).sum()], dtype=np.int64)

    def rows(self, binaries: int):
        """One row behind the other rows of a task that had shards: its number, the length and the sums."""
        if self.task is not None:
            cells = [pa.array([self.task], pa.int32()), *[pa.nulls(1, pa.binary())] * binaries, pa.array([np.append(self.length, self.sums).astype(np.int64).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["part", *(f"x{i}" for i in range(binaries)), "sizes"])


def counted(texts: DataFrame, bits: int, order: int = ORDER) -> DataFrame:
    """The grams of column text: for each ``FLUSH_TOKENS`` of a task one row at most for each part, by the first ``bits`` of their hash."""
    most = FLUSH_TOKENS

    def count(batches):
        def grams():
            for batch in batches:
                for _, buf, offsets in slices(batch, "text"):
                    words, _ = tokens(buf, offsets, order)
                    yield [*words, np.ones(len(words[0]), dtype=np.uint32)]

        yield from pooled(grams(), order, most, lambda keys, words, n: gram_rows(keys, words, *n, bits, np.uint32))

    return texts.select("text").mapInArrow(count, ", ".join(["part int", *(f"x{i} binary" for i in range(order + 2))]))


def train(texts: DataFrame, bits: int, task_bits: int, folder: str, order: int = ORDER) -> Model:
    """texts: the training texts in column text.  The grams fall into 1 << bits shards by their hash; each of 1 << task_bits tasks takes
    neighbouring ones, a shard at a time."""
    most, several = FLUSH_TOKENS, bits > task_bits
    wide = np.uint64 if several else np.uint32  # of counts that a row may hold for several flushes
    of_grams = lambda kind: (np.uint64, np.uint32, *[np.uint64] * (order - 1), kind)
    of_shorter = lambda length: (*[np.uint64] * (length + 2), *[wide] * 4)

    def cut_grams(batches):
        def grams():
            for batch in batches:
                first, lengths, *others, n = _whole(batch, of_grams(np.uint32))
                yield [np.repeat(first, lengths), *others, n.astype(np.uint64)]

        yield from pooled(grams(), order, most, lambda keys, words, n: gram_rows(keys, words, *n, bits, wide))

    def split(batches, length: int, passed: list):
        """The rows of grams; those of sums go into ``passed``."""
        for batch in batches:
            sums = batch.column(batch.num_columns - 1)
            if sums.null_count < len(sums):
                passed.append(batch.filter(sums.is_valid()))
            yield batch.filter(sums.is_null()).select(range(length + 7))

    def cut_shorter(length: int):
        def cut(batches):
            passed = []
            rows = (_whole(batch, of_shorter(length)) for batch in split(batches, length, passed))
            yield from pooled(([x.astype(np.uint64) for x in row] for row in rows), length, most, lambda *sums: shorter_rows(*sums, bits, wide))
            yield from passed

        return cut

    def sum_grams(batches):
        file, sizes = ShardFile(folder, f"grams{order}"), Sizes(order)

        def shards():
            for part, (first, lengths, *others, n) in _parts(batches, of_grams(wide)):
                keys, words, (n,) = summed([np.repeat(first, lengths), *others], [n.astype(np.uint64)])
                task = part >> (bits - task_bits)
                file.add(part, task, keys, [(n, np.uint8)])
                sizes.add(task, n, n)
                yield shorter(words, n, n)

        yield from pooled(shards(), order - 1, most, lambda *sums: shorter_rows(*sums, task_bits, wide))
        file.close()
        yield from sizes.rows(order + 5)

    def sum_shorter(length: int):
        binaries = length + 5 if length > 1 else 0

        def merge(batches):
            passed, file, sizes = [], ShardFile(folder, f"grams{length}"), Sizes(length)

            def shards():
                for part, held in _parts(split(batches, length, passed), of_shorter(length)):
                    keys, words, columns = summed(held[:length], [x.astype(np.uint64) for x in held[length:]])
                    named = dict(zip(("t", "c", "n1", "n2", "n3", "b"), columns, strict=True))
                    task = part >> (bits - task_bits)
                    file.add(part, task, keys, [(named[x], kind) for x, kind in columns_of(length, order)])
                    sizes.add(task, named["c"], named["b"])
                    if length > 1:
                        yield shorter(words, named["b"], named["c"])

            yield from pooled(shards(), length - 1, most, lambda *sums: shorter_rows(*sums, task_bits, wide))
            file.close()
            yield from sizes.rows(binaries)
            for rows in passed:  # what the tasks of longer grams counted
                cells = [rows.column(0), *[pa.nulls(rows.num_rows, pa.binary())] * binaries, rows.column(rows.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(cells, names=["part", *(f"x{i}" for i in range(binaries)), "sizes"])

        return merge

    def dealt(rows: DataFrame, cut) -> DataFrame:
        """By task; where a task has several shards, its rows are cut into theirs."""
        rows = rows.repartitionById(1 << task_bits, "part")
        return (rows.mapInArrow(cut, rows.schema) if several else rows).sortWithinPartitions("part")

    def schema(binaries: int) -> str:
        return ", ".join(["part int", *(f"x{i} binary" for i in range(binaries)), "sizes binary"])

    merged = dealt(counted(texts, task_bits, order), cut_grams).mapInArrow(sum_grams, schema(order + 5))
    for length in range(order - 1, 0, -1):
        merged = dealt(merged, cut_shorter(length)).mapInArrow(sum_shorter(length), schema(length + 5 if length > 1 else 0))
    tasks = {k: set() for k in range(1, order + 1)}
    totals = {k: np.zeros(8, np.int64) for k in tasks}
    for task, blob in merged.collect():
        length, *sums = np.frombuffer(blob, dtype=np.int64)
        tasks[int(length)].add(task)
        totals[int(length)] += sums
    return Model(folder, bits, task_bits, order, tasks, {k: x.tolist() for k, x in totals.items()})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """order: words in a gram, two at least.  doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    texts = id_text(docs, id_col, text_col).withColumn("held_out", held)
    training = texts.where("not held_out")
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // SHARD_BYTES).bit_length())
    model = docs.sparkSession.sparkContext.broadcast(train(training, bits, min(bits, TASK_BITS), shared_folder(docs.sparkSession, "model"), order))

    def score(batches):
        m = model.value
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                grams, begins = tokens(buf, offsets, m.order)
                p, c = m.probability(grams)
                row = np.repeat(np.arange(rows.num_rows), np.diff(begins))
                total = lambda x: np.bincount(row, weights=x, minlength=rows.num_rows)  # noqa: B023, E731
                n, logs = np.diff(begins), total(np.log10(p))
                base = total(np.log10((c + 0.5) / (m.n + 0.5 * (m.v + 1))))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(n.astype(np.int64)), pa.array(total(c > 0).astype(np.int64)), pa.array(np.full(len(n), m.n, dtype=np.int64)), pa.array(base), pa.array(logs), pa.array(10.0 ** (-logs / n))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return texts.select("doc_id", "text", "held_out").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLE: dict[str, str] = {}
