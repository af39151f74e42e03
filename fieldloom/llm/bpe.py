"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Words of a batch that were not met before are inserted into one byte trie. A depth-first walk gives every
node (a prefix of some word) its *last token*: the only vocabulary entry that is a suffix of the prefix and
is compatible with the last token of what precedes it. Prefixes shared by several words are thus encoded
once, and the ids of a word are read back along the walk's stack.

Two neighbouring tokens are compatible when merging their joined bytes never crosses the border between
them. That is decided on the spines of their merge trees, without running the merges again.

Defined results: an empty table gives no rows; a null or empty text has no ids and decodes to the empty text; very long
texts are encoded whole; of equal merges the leftmost comes first, so that there are no ties; strings of added tokens
inside a text become those tokens' ids; rows are encoded one by one, so that null ids, repeated ids and repeated rows
change nothing; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, record_batch, sliced

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies of this family.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Entries kept in the worker's caches; a full cache is emptied, which changes no result.
CACHE = 700_000
FOREVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class BpeCodec:
    """A byte-level BPE vocabulary from the JSON text of a tokenizer file."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        alphabet = byte_alphabet()

        def raw(s: str) -> bytes:
            return bytes(alphabet[c] for c in s)

        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.id_of = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in added}
        by_id = {i: s for s, i in self.id_of.items()} | {i: s.encode() for s, i in added.items()}
        self.bytes_of = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.added = added
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        #: The same, with every byte as the character of its number: slices of such strings are cheap.
        self.id_of_latin = {token.decode("latin-1"): i for token, i in self.id_of.items()}
        lengths: dict[str, set[int]] = {}
        for token in self.id_of_latin:
            if len(token) >= 3:
                lengths.setdefault(token[-3:], set()).add(len(token))
        self.long_lengths = {tail: sorted(found, reverse=True) for tail, found in lengths.items()}
        #: By the last three bytes of a prefix: the lengths to try, longest first.
        self.lengths: dict[str, tuple[int, ...]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, whole = self.id_of[a], self.id_of[b], self.id_of[a + b]
            self.rank.setdefault((left, right), k)
            self.parts.setdefault(whole, (left, right, k))
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}

    # -- which tokens may follow each other

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that uses it up) along one side of a token's merge tree."""
        out, used = [(token, FOREVER)], FOREVER
        while token in self.parts:
            used = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, used))
        return out

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 4 * CACHE:
                self.fits.clear()
            known = True
            heads = self.spine(b, 0)
            for left, left_used in self.spine(a, 1):
                for right, right_used in heads:
                    r = self.rank.get((left, right))
                    # among equal merges the leftmost comes first
                    if r is not None and r < left_used and r <= right_used:
                        known = False
                        break
                if not known:
                    break
            self.fits[(a, b)] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether the token's own bytes encode to it alone."""
        return token not in self.parts or self.compatible_inside(token)

    def compatible_inside(self, token: int) -> bool:
        left, right, rank = self.parts[token]
        key = (-1, token)
        known = self.fits.get(key)
        if known is None:
            known = self.rank[(left, right)] == rank and self.reachable(left) and self.reachable(right)
            if known:
                for a, a_used in self.spine(left, 1):
                    for b, b_used in self.spine(right, 0):
                        r = self.rank.get((a, b))
                        if r is not None and (a, b) != (left, right) and r < min(a_used, rank) and r <= min(b_used, rank):
                            known = False
            self.fits[key] = known
        return known

    # -- the trie

    def tries(self, tail: str) -> tuple[int, ...]:
        """Lengths of vocabulary entries that may end a prefix with these last (up to three) bytes."""
        short = [n for n in (2, 1) if n <= len(tail) and tail[-n:] in self.id_of_latin]
        out = self.lengths[tail] = (*self.long_lengths.get(tail, ()), *short)
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word, through one trie of all of them.

        Words in byte order are the trie in depth-first order: going to the next word climbs to the
        deepest shared prefix, whose states are on the stack, and descends along the bytes that are new.
        """
        out = {}
        tokens, lengths, fits, compatible = self.id_of_latin, self.lengths, self.fits, self.compatible
        before = ""
        last, back = [-1], [0]  # by depth: the last token of the prefix, and its length in bytes
        for path, word in sorted((w.encode().decode("latin-1"), w) for w in words):
            shared, most = 0, min(len(path), len(before))
            while shared < most and path[shared] == before[shared]:
                shared += 1
            before = path
            del last[shared + 1 :]
            del back[shared + 1 :]
            depth = shared
            for depth in range(shared + 1, len(path) + 1):
                tail = path[depth - 3 if depth > 3 else 0 : depth]
                for length in lengths.get(tail) or self.tries(tail):
                    start = depth - length
                    if start < 0:
                        continue
                    token = tokens.get(path[start:depth])
                    if token is None:
                        continue
                    if start == 0:
                        if self.reachable(token):
                            break
                        continue
                    known = fits.get((last[start], token))
                    if known or known is None and compatible(last[start], token):
                        break
                last.append(token)
                back.append(length)
            ids, depth = [], len(path)
            while depth:
                ids.append(last[depth])
                depth -= back[depth]
            ids.reverse()
            out[word] = array("I", ids).tobytes()
        return out

    # -- texts

    def prepare(self, texts: list[str]) -> None:
        """Encode what is new in a batch of texts: the pieces between single spaces, through one trie."""
        known = self.pieces
        if len(known) > CACHE:
            known.clear()
        new: set[str] = set()
        for text in texts:
            new.update([p for p in text.split(" ")[1:] if p not in known])
        split = {}
        for piece in new:
            if not piece or SPLIT.match(piece).group()[0].isspace():
                known[piece] = None  # not the start of a word: white space runs into it
            elif piece.isalpha() and piece.isascii():
                split[piece] = (" " + piece,)
            else:
                split[piece] = SPLIT.findall(" " + piece)
        ids = self.learn({w for ws in split.values() for w in ws})
        for piece, ws in split.items():
            known[piece] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def encode_plain(self, text: str) -> bytes:
        """Ids (little-endian unsigned 32-bit integers) of a text without added tokens.

        A space before a non-space always opens a word, so that pieces between single spaces are encoded
        apart from each other. Texts with other runs of white space take the whole pattern.
        """
        head, *rest = text.split(" ")
        known = self.pieces
        try:
            tail = b"".join([known[p] for p in rest])
        except KeyError:
            self.prepare([text])
            return self.encode_plain(text)
        except TypeError:
            return self.encode_slowly(text)
        return (self.encode_slowly(head) if head else b"") + tail

    def encode_slowly(self, text: str) -> bytes:
        found = SPLIT.findall(text)
        if len(self.words) > CACHE:
            self.words.clear()
        if missing := {w for w in found if w not in self.words}:
            self.words |= self.learn(missing)
        return b"".join([self.words[w] for w in found])

    def encode(self, text: str) -> bytes:
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self.encode_plain(text)
        out = []
        for part in self.added_pattern.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                out.append(self.encode_plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_codecs: dict[str, BpeCodec] = {}


def codec(blob: bytes) -> BpeCodec:
    """The worker's codec for a tokenizer file, built once in a process."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = BpeCodec(blob)
    return _codecs[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encodings(bpe: BpeCodec, texts: list[str]):
    """(ids, (SHA-256 of the ids, SHA-256 of the decoded text)) of every text; equal neighbours share one encoding.

    A mix has the copies of a row one after another.
    """
    last = None
    for text in texts:
        if text != last:
            last, ids = text, bpe.encode(text)
            hashes = hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()
        yield ids, hashes


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of ints) of every row.

    The tokenizer file is read on the driver and broadcast; its size does not depend on the data.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or default_path(), "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        bpe = codec(blob.value)
        for batch in sliced(batches):
            count, ids_sha, text_sha, all_ids = [], [], [], []
            texts = batch.column(1).to_pylist()
            bpe.prepare(texts)
            for ids, hashes in encodings(bpe, texts):
                count.append(len(ids) // 4)
                ids_sha.append(hashes[0])
                text_sha.append(hashes[1])
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), count, ids_sha, text_sha]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(all_ids), "<i4"))))
            yield record_batch(schema, columns)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(docs).mapInArrow(run, kinds)


def decode_ids(frame: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids (null ids: null text)."""
    with open(tokenizer_path or default_path(), "rb") as f:
        blob = frame.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = codec(blob.value)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(np.array(ids, "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return frame.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), with_ids=False)
