"""Byte-level BPE over whole texts: encoding, decoding and token counts.

*Encoding* a long text goes by *tree concatenation*.  The text is halved, wherever that falls, down
to leaves, all leaves are encoded in one parallel batch, and halves are joined: a window of the last
tokens of the left and the first of the right half is encoded anew, and grows until it agrees with
both.  It agrees with a side at a place between two characters where the tokenizer's pattern always
cuts (what stands before such a place and what follows it are encoded the same with or without the
other), or, where an unsplit run of letters, digits, signs or white space fills the side, when its
outermost token is that side's token: a sequence of BPE tokens is the encoding of its bytes if and
only if each two neighbours are the encoding of their own bytes.  So the spliced sequence is exact.

*Counting* cuts long texts at safe places only (white space after another character) and encodes
what lies between in batches; no ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern by which the byte-level vocabularies split text (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that this module's pattern engine and the library class alike; a text with others
#: is split by the library.
PLAIN = (
    "\\x00-\u052f\u2000-\u2064\u20a0-\u20bf\u2190-\u2426\u2500-\u2b73\u3000-\u303f"
    "\u3041-\u3096\u3099-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f64f"
)
#: Characters of a safe piece, of a leaf of the tree, of a text that goes by the tree (if longer),
#: and of a word that the rank table takes.
PIECE, LEAF, LONG, WORD = 1 << 18, 4096, 4096, 2048
#: Tokens on each side of a window at first; leaves from which a batch takes threads, and how many.
WINDOW, MANY, THREADS = 8, 16, 2
BYTES_PER_BATCH = 1 << 20
#: Places where the pattern cuts whatever stands around: after letters or digits that end, and
#: before white space that follows another character.
EDGE = (
    rf"(?V1)(?<=[[{PLAIN}]&&\p{{L}}])(?=[[{PLAIN}]&&\P{{L}}])|(?<=[[{PLAIN}]&&\p{{N}}])(?=[[{PLAIN}]&&\P{{N}}])"
    rf"|(?<=[[{PLAIN}]&&\S])(?=[[{PLAIN}]&&\s])"
)
#: A run that the pattern leaves whole, but for a part that both its encodings share.
RUN = rf"(?V1)[[{PLAIN}]&&\p{{L}}]+|[[{PLAIN}]&&\p{{N}}]+|[[{PLAIN}]&&[^\s\p{{L}}\p{{N}}']]+|[[{PLAIN}]&&\s]+"


def safe_pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """Cut text into pieces of about limit characters, only where white space follows another
    character; no token of the pattern spans such a place.  Without one, the piece is longer."""
    import regex

    edge, at = regex.compile(r"\S(?=\s)"), 0
    while len(text) - at > limit:
        found = edge.search(text, at + limit - 1)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


class Encoder:
    """A tokenizer of the tokenizers library with a byte-level vocabulary, for whole texts.

    Where the vocabulary's ids follow its merges, leaves and windows are encoded by a rank table of
    the same merges (tiktoken), which gives the same ids several times faster; else, and where a
    character may be classed otherwise, by the library.  joins counts the joins so far."""

    def __init__(self, spec: str, leaf: int = LEAF, piece: int = PIECE, long: int = LONG, ranked: bool = True):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.gap, self.odd = regex.compile(rf"\s{{{WORD}}}"), regex.compile(f"[^{PLAIN}]")
        self.edge, self.run = regex.compile(EDGE), regex.compile(RUN)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.leaf, self.piece, self.long, self.joins = leaf, piece, long, 0
        alphabet = {c: b for b, c in byte_alphabet().items()}
        self.raw: list[bytes] = []
        for i in range(self.tok.get_vocab_size(with_added_tokens=True)):
            token = self.tok.id_to_token(i) or ""
            own = i in self.special.values() or any(c not in alphabet for c in token)
            self.raw.append(token.encode() if own else bytes(alphabet[c] for c in token))
        self.name = [str(i) for i in range(len(self.raw))]
        self.ranks = rank_table(spec, self.raw, self.special) if ranked else None

    def plain(self, text: str) -> bool:
        """Whether the rank table may encode it: known characters, no long unsplit word."""
        return self.ranks is not None and not self.odd.search(text) and (len(text) <= WORD or max(map(len, text.split()), default=0) <= WORD and not self.gap.search(text))

    def whole(self, text: str) -> list[int]:
        """The ids of a text without special strings, in one go."""
        return self.ranks.encode_ordinary(text) if self.plain(text) else self.tok.encode(text, add_special_tokens=False).ids

    def batch(self, texts: list[str], threads: int = 1) -> list[list[int]]:
        """The same for many at once."""
        plain = list(map(self.plain, texts))
        if len(texts) < MANY:
            return [self.ranks.encode_ordinary(t) if p else self.tok.encode(t, add_special_tokens=False).ids for t, p in zip(texts, plain, strict=True)]
        by_rank = iter(self.ranks.encode_ordinary_batch([t for t, p in zip(texts, plain, strict=True) if p], num_threads=threads) if any(plain) else ())
        others = iter(self.tok.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False) if not all(plain) else ())
        return [next(by_rank) if p else next(others).ids for p in plain]

    def segments(self, text: str) -> list[str]:
        """Special strings and what lies between."""
        return [x for x in (self.cut.split(text) if self.cut else [text]) if x]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for x in self.segments(text):
            out += [self.special[x]] if x in self.special else self.tree(x) if len(x) > self.long else self.whole(x)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of tokens; the safe pieces of all texts are encoded as one batch."""
        out, pieces, of = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            for x in self.segments(text):
                if x in self.special:
                    out[i] += 1
                    continue
                for piece in safe_pieces(x, self.piece):
                    if len(piece) > WORD and (max(map(len, piece.split()), default=0) > WORD or self.gap.search(piece)):
                        out[i] += len(self.tree(piece))  # no safe place for long
                    else:
                        pieces.append(piece)
                        of.append(i)
        for i, ids in zip(of, self.batch(pieces), strict=True):
            out[i] += len(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")

    def tree(self, text: str) -> list[int]:
        """Tree concatenation of a text without special strings."""
        leaves = [text[i : i + self.leaf] for i in range(0, len(text), self.leaf)]
        level = self.batch(leaves, THREADS)
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two texts together from those of each."""
        raw, width = self.raw, WINDOW
        self.joins += 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            one, two = b"".join(map(raw.__getitem__, left[a:])), b"".join(map(raw.__getitem__, right[:b]))
            follows = raw[right[b]][0] if b < len(right) else 0
            width *= 2
            if (a and one[0] & 0xC0 == 0x80) or follows & 0xC0 == 0x80:
                continue  # not between two characters
            before, after = one.decode(), two.decode()
            new = self.whole(before + after)
            first = self.settled(before, new, left[a:], a == 0, True)
            last = self.settled(after, new[::-1], right[:b][::-1], b == len(right), False)
            if first is None or last is None:
                continue
            start, end = self.token_at(new, first), self.token_at(new, len(one) + len(two) - last)
            if start is not None and end is not None:
                return left[: a + self.token_at(left[a:], first)] + new[start:end] + right[b - self.token_at(right[:b][::-1], last) :]

    def settled(self, side: str, new: list[int], old: list[int], whole: bool, at_left: bool) -> int | None:
        """Bytes from the outer end of a side of the window up to a place where the old encoding of
        that side and the new one agree for good; None if there is none yet."""
        cuts = [m.start() for m in self.edge.finditer(side) if 0 < m.start() < len(side)]
        if cuts:
            outer = side[: cuts[-1]] if at_left else side[cuts[0] :]
            return len(outer.encode())
        if whole or self.run.fullmatch(side) and new and new[0] == old[0]:
            return 0
        return None

    def token_at(self, ids: list[int], size: int) -> int | None:
        """How many of the ids make up the first so many bytes; None if a token spans the place."""
        for n, i in enumerate(ids):
            if size <= 0:
                return n if not size else None
            size -= len(self.raw[i])
        return len(ids) if not size else None


def rank_table(spec: str, raw: list[bytes], special: dict[str, int]):
    """The merges as ranks of byte strings, if ids follow them; else None."""
    import json

    import tiktoken

    model = json.loads(spec)["model"]
    alphabet = {c: b for b, c in byte_alphabet().items()}
    merged = [bytes(alphabet[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    single = [x for x in raw if len(x) == 1]
    ids = {x: i for i, x in enumerate(raw) if i not in special.values()}
    order = [ids.get(x, -1) for x in merged]
    if model.get("ignore_merges") or len(single) != 256 or len(ids) != 256 + len(merged) or order != sorted(set(order)) or order[:1] < [256]:
        return None
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})


def byte_alphabet() -> dict[int, str]:
    """The printable character of each byte in byte-level vocabularies."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


def by_bytes(batch: pa.RecordBatch, column: int, most: int = BYTES_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about equal bytes of text, one row at least."""
    start, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def load_spec(docs: DataFrame, path: str):
    """The vocabulary file, read on the driver and broadcast (a fixed file of a few MB)."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with two more columns: the token ids of the whole text and the text they decode to.

    A null text counts as empty: no ids, and the empty text.  Special strings inside a text
    become special tokens, as in the library.  Rows, ids and other columns pass unchanged,
    repeated or null as they are; columns of the names asked for are replaced."""
    spec, schema = load_spec(docs, path), docs.drop(ids, decoded)
    kept = schema.columns
    at = kept.index(text)

    def run(batches):
        encoder = Encoder(spec.value)
        for whole in batches:
            for batch in by_bytes(whole, at):
                found, back = [], []
                for t in batch.column(at).to_pylist():
                    own = encoder.encode(t or "")
                    back.append(encoder.decode(own))
                    found.append(np.array(own, np.int32))  # numbers as objects would take eight times the memory
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32())), pa.array(back, pa.string())], names=[*kept, ids, decoded])

    return schema.mapInArrow(run, spark_schema(schema, f"`{ids}` array<int>, `{decoded}` string"))


def spark_schema(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins) of every row: what encode_documents
    finds, reduced to digests where it is found, so that no ids are moved; n_joins counts the joins
    of the tree.

    A null text counts as empty.  Null and repeated doc_ids give a row each."""
    spec = load_spec(docs, path)

    def run(batches):
        encoder = Encoder(spec.value)
        names = encoder.name
        for whole in batches:
            for batch in by_bytes(whole, 1):
                n, a, b, joins = [], [], [], []
                for t in batch.column(1).to_pylist():
                    encoder.joins = 0
                    found = encoder.encode(t or "")
                    joins.append(encoder.joins)
                    n.append(len(found))
                    a.append(hashlib.sha256(",".join(map(names.__getitem__, found)).encode()).hexdigest())
                    b.append(hashlib.sha256(encoder.decode(found).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(joins, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; over_limit: more tokens than limit.

    Batches are balanced by bytes, long texts are split at safe boundaries, and only lengths come
    back.  path ends in .json (tokenizers) or .model (sentencepiece).  A null text counts as
    empty; null and repeated doc_ids give a row each."""
    pieces = path.endswith(".model")
    if pieces:
        with open(path, "rb") as f:
            spec = docs.sparkSession.sparkContext.broadcast(f.read())
    else:
        spec = load_spec(docs, path)

    def run(batches):
        if pieces:
            from sentencepiece import SentencePieceProcessor

            sp = SentencePieceProcessor(model_proto=spec.value)
            count = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        elif '"ByteLevel"' in spec.value:
            encoder = Encoder(spec.value)
            count = encoder.counts
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(spec.value)
            tok.no_padding()
            tok.no_truncation()
            count = lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        for whole in batches:
            for batch in by_bytes(whole, 1):
                n = count([t or "" for t in batch.column(1).to_pylist()])
                size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
