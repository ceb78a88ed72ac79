"""Secrets: fixed patterns, and strings in a sensitive context that a primed zstandard cannot shorten.

A candidate is a run of ``LEAST`` or more characters of the alphabet of keys that no fixed pattern
covers, and that a sensitive word precedes within ``REACH`` characters. Its novelty is its marginal
cost: how many bytes the compressed surroundings grow by when the candidate is put in, less copies of
it that stand there. The compressor is primed with words of code and settings and with a dictionary
of identifiers (the letters-only pieces of a public tokenizer's vocabulary), so that a name made of
known parts costs far less than its length, and a random string of any alphabet all of it.
Candidates that cost ``RATIO`` of their length are reported as kind ``novel``; words of letters in
one case (or with a capital first) must have ``WORD`` characters, as foreign words are also novel.
``marginal`` lists the cost of every span that is reported, base spans included.

Null, empty: no spans. Repeated rows give a row each; other columns are not read. A map over the
table: no shuffle, memory of one batch.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

#: The patterns of the contract, by kind as listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make a context sensitive.
WORDS = ("secret", "token", "passw", "passphrase", "pwd", "credential", "auth", "bearer", "private", "api", "key", "access", "signature", "session", "cookie", "salt", "login")
SENSITIVE = re.compile("(?ai)" + "|".join(WORDS))
#: Runs of the alphabet of keys, where they start, and words in one case.
RUN, STARTS, PLAIN = re.compile("[A-Za-z0-9+/_=-]+"), re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]"), re.compile("[A-Za-z]?[a-z]+|[A-Z]+")
REACH, AROUND = 40, 256
LEAST, WORD, RATIO = 8, 16, 0.9
#: Bytes by which the size of a compressed block varies anyway.
SLACK = 1
#: Pieces of the vocabulary that prime the compressor; the commonest come last, where they cost least.
PIECES = 20_000
#: What the compressor knows beforehand: words of code, names of settings, digits in order.
DICTIONARY = (
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2020-01-01T00:00:00 2021 2022 2023 2024 2025 1000 10000 127.0.0.1 "
    "import from return class public private static void string integer boolean function const let var null None True False self this new "
    "def async await export default module require include namespace struct enum interface implements extends override final abstract "
    "user_name username userId user_id account_id accountName customer session_id sessionId request response client_id clientId client_secret "
    "access_token refresh_token accessToken refreshToken api_key apiKey secret_key secretKey private_key privateKey public_key publicKey "
    "password passwd passphrase credential credentials authorization Authorization Bearer Basic authenticate authentication signature "
    "config configuration settings environment ENVIRONMENT variable DATABASE_URL database connection_string hostname localhost endpoint "
    "region bucket version release build production staging development testing example sample placeholder your_token_here changeme "
    "http:// https:// www. .com .org .net /api/v1/ /usr/local/bin /etc/ /var/log/ index.html package.json requirements.txt README.md "
    "getElementById addEventListener toString valueOf createElement setAttribute getItem setItem localStorage sessionStorage cookie "
    "logger.info logger.error print println printf System.out console.log Exception Error raise throw catch try finally while for if else "
    'token = " token: " secret = " key = " id = " name = " value = " type = " description = " "}, { [] () => == != && || += '
)
LEVEL = 9


@functools.cache
def identifiers(path: str, most: int = PIECES) -> str:
    """The ``most`` commonest letters-only pieces of a vocabulary, of four letters or more."""
    with open(path, encoding="utf-8") as f:
        ranks = json.load(f)["model"]["vocab"]
    words = sorted((rank, w.removesuffix("</w>")) for w, rank in ranks.items())
    known = dict.fromkeys(w for _, w in words if re.fullmatch("[a-z]{4,}", w))
    return " ".join(list(known)[:most][::-1])


class Novelty:
    """Marginal compressed bytes of a string within its surroundings."""

    def __init__(self, dictionary: str):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.z = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.z.compress(text.encode("utf-8", "surrogatepass")))

    def marginal(self, text: str, start: int, end: int) -> int:
        own = text[start:end]
        before, after = text[max(0, start - AROUND) : start].replace(own, ""), text[end : end + AROUND].replace(own, "")
        return self.size(before + own + after) - self.size(before + after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) by the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: int = LEAST, word: int = WORD, reach: int = REACH, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Incompressible candidates in a sensitive context that touch no base span."""
    low, out, done = text.lower(), [], -1
    if not any(w in low for w in WORDS):
        return out
    covered = sorted((s, e) for s, _, e in base)
    k, end_of_base = 0, 0
    for hit in SENSITIVE.finditer(text):
        for first in STARTS.finditer(text, max(hit.end(), done + 1), hit.start() + reach + 1):
            start = done = first.start()
            end = RUN.match(text, start).end()
            while k < len(covered) and covered[k][0] < end:
                end_of_base = max(end_of_base, covered[k][1])
                k += 1
            if start < end_of_base or end - start < least or end - start < word and PLAIN.fullmatch(text, start, end):
                continue
            if novelty.marginal(text, start, end) + SLACK >= ratio * (end - start):
                out.append((start, 3, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, **bounds) -> DataFrame:
    """Per document: counts of the base kinds, base_sha256, spans (all), n_novel, marginal.

    ``vocabulary``: a tokenizer file that the driver reads; ``bounds``: those of ``novel_spans``.
    """
    dictionary = identifiers(vocabulary or bpe.default_path()) + " " + DICTIONARY  # some 150 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = novel_spans(text, base, novelty, **bounds) if text else []
                kinds, both = [k for _, k, _ in base], sorted(base + more)
                costs = ",".join(str(novelty.marginal(text, s, e)) for s, _, e in both)
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), len(more), costs))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[batch.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "marginal"])

    given = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = given.schema[id_col].dataType.simpleString()
    return given.mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, marginal string")
