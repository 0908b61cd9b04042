"""Exact deduplication by Patricia-trie owners.

Texts are equal when they are identical after white space ([\\x20\\x09-\\x0D]) is deleted.  Each
Arrow batch first reduces its own copies, so that a group of copies of any size sends one row a
batch.  The rows left are dealt by length and content hash to owners.  An owner inserts the whole
normalised byte strings into a compressed radix trie; a terminal node stores the row that stays.
Where a trie grows beyond a budget, its heaviest subtree goes to a local file of the task and is
worked off later, as a trie of its own.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, spool

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text and rows that the trie of a task holds before it spills.
BUDGET = 96 << 20


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE)


def standing(text: str | None, doc_id) -> tuple:
    """Sorts what stays first: most code points, then the smallest id, null ids last."""
    return (-len(text or ""), doc_id is None, 0 if doc_id is None else doc_id)


class _Node:
    __slots__ = ("children", "file", "value")

    def __init__(self):
        self.children: dict[int, list] = {}  # first byte -> [label, node]
        self.value = None
        self.file = None


class Trie:
    """A compressed radix trie from byte strings to values that merge(old, new) reduces.

    A value is (standing, members, owners, row); weight counts what is held in memory."""

    def __init__(self, budget: int = BUDGET):
        self.root, self.budget, self.held = _Node(), budget, 0

    def insert(self, key: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((key[at:], value), node.file)
                return
            if at == len(key):
                break
            edge = node.children.get(key[at])
            if edge is None:
                leaf = _Node()
                node.children[key[at]] = [key[at:], leaf]
                self.held += len(key) - at + 200
                node = leaf
                break
            label = edge[0]
            if key.startswith(label, at):
                node, at = edge[1], at + len(label)
                continue
            n = common(label, key, at)
            middle = _Node()
            middle.children[label[n]] = [label[n:], edge[1]]
            edge[0], edge[1] = label[:n], middle
            self.held += 200
            node, at = middle, at + n
        old = node.value
        node.value = value if old is None else joined(old, value)
        self.held += weight(value) if old is None else 16 * len(value[2])
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        """Move the heaviest subtree below the first branch into a file."""
        node = self.root
        while len(node.children) == 1 and node.value is None:
            only = next(iter(node.children.values()))
            if only[1].file is not None:
                return
            node = only[1]
        best, most = None, 0
        for edge in node.children.values():
            size = held(edge[1], len(edge[0]))
            if size > most:
                best, most = edge, size
        if best is None:
            return
        file = tempfile.TemporaryFile()  # noqa: SIM115
        for item in walk(best[1]):
            pickle.dump(item, file)
        label, old = best
        self.held -= most
        best[1] = _Node()
        best[1].file = file

    def items(self) -> Iterator[tuple]:
        """The values, of what was spilled as well."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.file is not None:
                node.file.seek(0)
                below = Trie(self.budget)
                while True:
                    try:
                        below.insert(*pickle.load(node.file))
                    except EOFError:
                        break
                node.file.close()
                yield from below.items()
            if node.value is not None:
                yield node.value
            stack += [e[1] for e in node.children.values()]


def held(node: _Node, above: int) -> int:
    """Bytes in memory at and below a node."""
    total, stack = 0, [(node, above)]
    while stack:
        node, label = stack.pop()
        total += label + 200 + (weight(node.value) if node.value is not None else 0)
        stack += [(child, len(own)) for own, child in node.children.values()]
    return total if total > above + 200 else 0


def walk(node: _Node) -> Iterator[tuple[bytes, tuple]]:
    stack = [(b"", node)]
    while stack:
        key, node = stack.pop()
        if node.value is not None:
            yield key, node.value
        if node.file is not None:
            node.file.seek(0)
            while True:
                try:
                    rest, value = pickle.load(node.file)
                except EOFError:
                    break
                yield key + rest, value
            node.file.close()
            node.file = None
        stack += [(key + label, child) for label, child in node.children.values()]


def common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:]."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def joined(a: tuple, b: tuple) -> tuple:
    best = a if a[0] <= b[0] else b
    small, big = (a[2], b[2]) if len(a[2]) < len(b[2]) else (b[2], a[2])
    big.extend(small)
    return best[0], a[1] + b[1], big, best[3]


def weight(value: tuple) -> int:
    row = value[3]
    return 200 + (sum(len(x) if isinstance(x, str | bytes) else 32 for x in row.values()) if isinstance(row, dict) else 0)


def _reduced(docs: DataFrame, doc_id: str, text: str, names: list[str], members: bool) -> DataFrame:
    """One row for each group of copies of a batch, with the row that would stay of them; with
    members, a row for each document, of which that row alone carries the text."""
    rep, best, size, sha, key = names
    base = docs if not members else docs.select(doc_id, text)
    columns = base.columns
    at, no = columns.index(text), columns.index(doc_id)
    position = at

    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, ids = batch.column(at).to_pylist(), batch.column(no).to_pylist()
            groups: dict[bytes, list[int]] = {}
            shas, hashes = [], []
            for i, t in enumerate(texts):
                own = normal(t)
                digest = hashlib.sha256(own)
                shas.append(digest.hexdigest())
                hashes.append(int.from_bytes(digest.digest()[:8], "big", signed=True) ^ len(own))
                groups.setdefault(own, []).append(i)
            leads, sizes, reps = [False] * len(texts), [0] * len(texts), [0] * len(texts)
            for own in groups.values():
                lead = min(own, key=lambda i: standing(texts[i], ids[i]))
                leads[lead], sizes[lead] = True, len(own)
                for i in own:
                    reps[i] = serial
                serial += 1
            more = [pa.array(reps, pa.int64()), pa.array(leads, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(hashes, pa.int64())]
            out = pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, *names])
            if members:
                kept = pa.array([t if lead else None for t, lead in zip(texts, leads, strict=True)], batch.column(at).type)
                yield out.set_column(position, text, kept)
            else:
                yield out.filter(pa.array(leads))

    extra = StructType.fromDDL(f"`{rep}` long, `{best}` boolean, `{size}` long, `{sha}` string, `{key}` long")
    return base.mapInArrow(run, StructType([*base.schema.fields, *extra.fields]))


def _dealt(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Dealt to owners by length and content hash (the hash is mixed with the length)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.col(key))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """A row for each document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  The row with the most code points stays, then that with the
    smallest id, null ids last; of rows alike in text and id exactly one has kept = true.  An
    empty table gives none."""
    names = ["rep", "lead", "members", "text_sha256", "deal"]
    local = spool(_reduced(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", names, True), "exact", as_is=True)

    def own(batches):
        trie = Trie(budget)
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for t, i, r, m in zip(c["text"], c["doc_id"], c["rep"], c["members"], strict=True):
                trie.insert(normal(t), (standing(t, i), m, [r], (i, r)))
        out: list[list] = [[], [], [], []]
        for _, members, reps, (keep, rep) in trie.items():
            out[0] += reps
            for column, v in zip(out[1:], (keep, rep, members), strict=True):
                column += [v] * len(reps)
            if len(out[0]) > 50_000:
                yield table(out)
                out = [[], [], [], []]
        yield table(out)

    kind = local.schema["doc_id"].dataType

    def table(out):
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], to_arrow_type(kind)), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["rep", "keep_id", "keep_rep", "group_size"])

    owners = _dealt(local.where("lead").select("rep", "doc_id", "text", "members", "deal"), "text", "deal").mapInArrow(own, f"rep long, keep_id {kind.simpleString()}, keep_rep long, group_size long")
    return local.select("rep", "doc_id", "lead", "text_sha256").join(owners, "rep").select("doc_id", "keep_id", "group_size", (F.col("lead") & (F.col("rep") == F.col("keep_rep"))).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns.

    Which stays: as in classes().  Nothing is written between; the owners return the rows."""
    names = fresh(docs, "rep", "lead", "members", "text_sha256", "deal")
    size, deal = names[2], names[4]
    columns, schema = docs.columns, docs.schema
    local = _reduced(docs, doc_id, text, names, False).select(*columns, size, deal)

    def own(batches):
        trie, kind = Trie(budget), None
        for batch in batches:
            kind = kind or pa.schema([batch.schema.field(c) for c in columns])
            for row in batch.to_pylist():
                members = row.pop(size)
                row.pop(deal)
                trie.insert(normal(row[text]), (standing(row[text], row[doc_id]), members, [], row))
        rows: list[dict] = []
        held = 0
        for _, _, _, row in trie.items():
            rows.append(row)
            held += len(row[text] or "") + 100
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    return _dealt(local, text, deal).mapInArrow(own, schema)


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as own from documents),
g as (select own, arg_min(doc_id, (-length(text), doc_id)) as keep_id, count(*) as group_size from d group by own)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(own) as text_sha256 from d join g using (own)
"""
