"""Secret scans: fixed patterns, and strings that stay novel to a primed compressor.

Base spans come from three patterns (assignments to sensitive names, access key ids, long lower-case
hexadecimal runs). The method adds candidates near sensitive names: strings of ``LEAST`` or more characters that keys
are written in. Each candidate's marginal size is the zstandard size of its surroundings with it, less that without it,
under a dictionary of identifiers (names of a programming language and of settings); a candidate that costs at least
``NOVEL`` bytes for each of its characters is incompressible there and is reported. What occurs in the surroundings or
among identifiers costs little. Nothing but this cost decides about a candidate.

Defined results: an empty table gives no rows; a null or empty text has no spans; positions are code points with
exclusive ends; ties in the start go by kind; base spans stay, and a candidate that overlaps one is dropped; a cost of
the limit itself is novel; very long texts are scanned whole; rows are judged one by one, so that null ids, repeated ids
and repeated rows change nothing; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import re
import string
import sys

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, record_batch, sliced

#: The base patterns, and the least length of what they must hold.
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Names that make their neighbourhood sensitive, and how far it reaches.
SENSITIVE_MARKS = ("key", "secret", "token", "passw", "credential", "bearer", "authorization", "private")
SENSITIVE = re.compile("(?ia)" + "|".join(SENSITIVE_MARKS))
REACH = 80
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
AROUND = 1024
NOVEL = 0.65
#: Words of configuration around secrets, beside the names of the language itself.
SETTINGS = "access_key secret_key api_key private_key public_key client_secret client_id auth_token refresh_token session_id authorization bearer basic password username credentials connection_string endpoint certificate BEGIN RSA PRIVATE KEY END environment variable configuration example placeholder changeme your_secret_here"


def identifiers() -> bytes:
    """What a candidate may be made of at little cost: keywords, built-in and module names, members of common types."""
    types = (str, bytes, list, dict, set, int, float, Exception)
    names = {*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names, *(name for t in types for name in dir(t))}
    return " ".join([string.ascii_letters + string.digits, *sorted(names), SETTINGS]).encode()


class Scanner:
    def __init__(self, novel: float = NOVEL):
        primed = zstandard.ZstdCompressionDict(identifiers(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)
        self.novel = novel

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the base spans in order."""
        found = []
        lower = text.lower()
        if any(mark in lower for mark in ASSIGN_MARKS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of novel strings near sensitive names, outside the base spans."""
        lower = text.lower()
        if not any(mark in lower for mark in SENSITIVE_MARKS):
            return []
        found, done = [], 0
        taken = iter(base)
        span = next(taken, None)
        for mark in SENSITIVE.finditer(text):
            # LEAST characters beyond the reach, so that all strings that start inside it are met
            for m in CANDIDATE.finditer(text, max(done, mark.end()), min(len(text), mark.end() + REACH + LEAST)):
                # whole strings only: the reach must not cut one
                start, end = m.start(), m.end()
                while end < len(text) and CANDIDATE_CHAR(text[end]):
                    end += 1
                if start and CANDIDATE_CHAR(text[start - 1]):
                    # the rest of a name: its value begins after the equals sign
                    sign = text.find("=", start, end)
                    start = end if sign < 0 else sign
                    while start < end and text[start] == "=":
                        start += 1
                if start < end and start > mark.end() + REACH:
                    break
                done = end
                if end - start < LEAST:
                    continue
                while span and span[2] <= start:
                    span = next(taken, None)
                if span and span[0] < end:
                    continue
                if self.cost(text, start, end) >= self.novel * (end - start):
                    found.append((start, 3, end))
        return found

    def cost(self, text: str, start: int, end: int) -> int:
        """Bytes that the candidate adds to its compressed surroundings."""
        before, after = text[max(0, start - AROUND) : start].encode(), text[end : end + AROUND].encode()
        size = self.compressor.compress
        return len(size(before + after + text[start:end].encode())) - len(size(before + after))

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = self.base(text)
        return base, sorted(base + self.added(text, base))


CANDIDATE_CHAR = re.compile(r"[A-Za-z0-9+/_=-]").match


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(docs: DataFrame, novel: float = NOVEL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
        scanner = Scanner(novel)
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = scanner.scan(text)
                kinds = [kind for _, kind, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield record_batch(schema, [batch.column(0), *([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5)])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))
