"""Token counts, long documents by overlap resynchronisation.

A document of more than CHUNK code points is encoded in chunks that overlap. Two neighbouring
encodings are spliced at a boundary that is proven stable: white space lies there, which no
token crosses, and both encodings show a token that begins at the same place behind it. A chunk
with no such place in its overlap is widened until there is one, or the text ends. A shorter
document is one chunk.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

LIMIT = 2048
#: Code points of a chunk, and of the first overlap with the next one.
CHUNK, OVERLAP = 4096, 96
#: Chunks whose encodings are held at once.
RUN = 128
#: A normalizer that plain string functions do for Latin-1 texts, which it leaves composed, and what it takes for white space there.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WHITE = re.compile("[\t-\r \x85\xa0]+")
#: White space with text behind it: only ASCII white space, which every rule of the tokenizer takes for white space.
_EDGE = re.compile(r"[ \n\t\r](?=[!-~À-ɏͰ-ϿЀ-ӿ一-鿿])")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a vocabulary file, encoding on the calling thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _begins(encoding, at: int) -> int | None:
    """The number of tokens before the one that begins at ``at``; None if none does."""
    token = encoding.char_to_token(at)
    if token is None or encoding.token_to_chars(token)[0] != at:
        return None
    while token and encoding.token_to_chars(token - 1)[0] >= at:  # bytes of one character share its place
        token -= 1
    return token


def splice(text: str, left, left_at: int, left_stop: int, right, right_at: int) -> tuple[int, int] | None:
    """(tokens of ``left`` before, tokens of ``right`` before) the last stable boundary in their overlap.

    ``left`` encodes text[left_at:left_stop] and ``right`` what begins at ``right_at``. None if the overlap proves no boundary.
    """
    found = [m.end() for m in _EDGE.finditer(text, right_at, left_stop)]
    for at in reversed(found):
        a, b = _begins(left, at - left_at), _begins(right, at - right_at)
        if a is not None and b is not None:
            return a, b
    return None


def _encoded(tokenizer, text: str, chunk: int, overlap: int):
    """(start, encoding) of the chunks of a text, each with its overlap into the next one."""
    for first in range(0, len(text), chunk * RUN):
        starts = range(first, min(len(text), first + chunk * RUN), chunk)
        yield from zip(starts, tokenizer.encode_batch([text[s : s + chunk + overlap] for s in starts], add_special_tokens=False), strict=True)


def count_batch(tokenizer, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """Tokens of each text and the splices that gave them (0 for a text of one chunk).

    Invariant: text[:start of chunk i] is counted by earlier chunks up to their splice. A chunk
    that can't be spliced with the next one is encoded anew over twice the code points, at most
    to the end of the text; next ones that it then covers are skipped.
    """
    counts, splices = [0] * len(texts), [0] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= chunk]
    for i, e in zip(short, tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
        counts[i] = len(e)
    for i, text in enumerate(texts):
        if len(text) <= chunk:
            continue
        at = before = 0  # the open chunk's start, and how many of its tokens lie before its first splice
        stop, encoding = 0, None
        for start, following in _encoded(tokenizer, text, chunk, overlap):
            while encoding is not None and stop < min(len(text), start + chunk):
                cut = splice(text, encoding, at, stop, following, start)
                if cut is not None:
                    counts[i] += cut[0] - before
                    splices[i] += 1
                    before = cut[1]
                    break
                stop = min(len(text), at + 2 * (stop - at))
                encoding = tokenizer.encode(text[at:stop], add_special_tokens=False)
            else:
                if encoding is not None:
                    continue  # the open chunk was widened past this one
            at, stop, encoding = start, min(len(text), start + chunk + overlap), following
        counts[i] += len(encoding) - before
    return counts, splices


class Counter:
    """Counts of whole texts by the library of a vocabulary file.

    Latin-1 texts without special tokens are normalised by plain string functions where the file's normalizer is the
    one they stand for; the library then encodes them without it. All other texts it normalises itself.
    """

    def __init__(self, path: str):
        self.library, self.bare = load(path), None
        given = json.loads(self.library.to_str())
        self.special = [t["content"].lower() for t in given["added_tokens"]]
        if given["normalizer"] == _NORMALIZER:
            self.bare = load(path)
            self.bare.normalizer = None

    def normalised(self, text: str) -> str | None:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        text = _WHITE.sub(" ", text).lower()
        return None if any(s in text for s in self.special) else text

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
        """Tokens and splices of each text."""
        ready = [self.normalised(t) if self.bare is not None else None for t in texts]
        out = [(0, 0)] * len(texts)
        for tokenizer, chosen in ((self.bare, [i for i, t in enumerate(ready) if t is not None]), (self.library, [i for i, t in enumerate(ready) if t is None])):
            if chosen:
                found = count_batch(tokenizer, [texts[i] if ready[i] is None else ready[i] for i in chosen], chunk, overlap)
                for i, *pair in zip(chosen, *found, strict=True):
                    out[i] = pair
        return [n for n, _ in out], [k for _, k in out]


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit, n_splices of every whole text; other columns are ignored.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are each counted; a null doc_id stays null. A long text
    without white space is encoded as one chunk. ``n_splices`` tells where chunks of a document were spliced. ``path`` is a
    vocabulary file that exists on every worker, of a tokenizer that splits at ASCII white space.
    """

    def count(batches):
        counter = Counter(path)
        for batch in batches:
            n, splices = counter.counts([t or "" for t in batch.column(2).to_pylist()], chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(splices, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "n_splices"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), "text")
    found = map_arrow(rows, count, "doc_id long, n_bytes long, n_tokens long, n_splices long")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_splices")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())
