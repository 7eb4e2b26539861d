"""Token counts by a map-side two-tier lookup.

A text's token count is the sum over its pre-tokens, since no piece of the
vocabulary crosses the border before a run of word markers, or touches a line
break.  Tier one is a compact table of frequent pre-tokens and their token
counts, built from a bounded hash sample of the documents and broadcast.  Tier
two is a cache that each Python worker keeps between tasks; only what misses
both is encoded.  Pre-tokens never enter a shuffle, and neither the sample nor
the caches can change a count.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens);
repeated rows each give a row; an empty table gives an empty result; a pre-token
of any length is encoded whole, only those of up to ``MAX_CACHED`` characters are
kept.  The public tokenizer files must exist on every executor at the same path.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowseq.llm.common import bounded_batches

#: Rows in the hash sample that the frequent table is taken from (expected number).
SAMPLE_DOCS = 2_000
#: Entries of the frequent table, and of each worker's cache.
TABLE_ENTRIES = 60_000
CACHE_ENTRIES = 600_000
MAX_CACHED = 48
_SAMPLE_TASKS = 4

_MARK = "▁"
_CHUNK = re.compile(f"{_MARK}+[^{_MARK}\n]*|\n[^{_MARK}\n]*")

_caches: dict[str, dict[str, int]] = {}
_models: dict[str, object] = {}


def _model(path: str):
    """The sentencepiece model, loaded once a worker; None if its pieces can't be cut at pre-tokens."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        odd = [p for p in pieces if "\n" in p or re.search(f"[^{_MARK}]{_MARK}", p)]
        # The marker alone must be one piece and white space must be kept as it is.
        same = [len(sp.encode(x)) for x in ("", " ", "a  ", "\n")] == [0, 1, 2, 2] and sp.piece_to_id(_MARK) != sp.unk_id()
        _models[path] = (sp, not odd and same)
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """The keys of a text's pre-tokens.

    A key that starts with a line break stands for itself; any other key is what
    follows the first marker, with markers as spaces.
    """
    if not text:
        return []
    if "  " in text or " \n" in text or _MARK in text or text[0] in " \n" or text[-1] == " ":
        chunks = _CHUNK.findall(_MARK + text.replace(" ", _MARK))
        return [c if c[0] == "\n" else c[1:].replace(_MARK, " ") for c in chunks]
    return text.replace("\n", " \n").split(" ")


def count_key(sp, key: str) -> int:
    if not key:
        return 1  # a lone marker
    # A key after a line break follows no marker: take the one that encode() puts there away.
    return len(sp.encode(key)) - (key[0] == "\n")


def _counter(path: str, frequent: dict[str, int]):
    sp, additive = _model(path)
    if not additive:
        return lambda text: len(sp.encode(text))
    cache = _caches.setdefault(path, {})
    hot = frequent.get

    def count(text: str) -> int:
        total = 0
        missed = []
        for key in pre_tokens(text):
            n = hot(key)
            if n is None:
                n = cache.get(key)
                if n is None:
                    missed.append(key)
                    continue
            total += n
        for key in missed:
            n = cache.get(key)
            if n is None:
                n = count_key(sp, key)
                if len(key) <= MAX_CACHED:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[key] = n
            total += n
        return total

    return count


def frequent_table(docs: DataFrame, text_col: str, id_col: str, model_path: str, sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Token counts of the pre-tokens that are frequent in a hash sample of all rows."""
    rows = bounded_batches(docs).count()
    every = max(1, rows // sample_docs)
    limit = entries // _SAMPLE_TASKS

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(k for k in pre_tokens(text or "") if len(k) <= MAX_CACHED)
                if len(seen) > 20 * limit:
                    seen = Counter(dict(seen.most_common(10 * limit)))
        keys = [k for k, _ in seen.most_common(limit)]
        sp, _ = _model(model_path)
        yield pa.RecordBatch.from_pydict({"k": [keys], "n": [[count_key(sp, k) for k in keys]]}, schema=pa.schema([("k", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))]))

    # By row, not by id or text: those may be alike in very many rows.
    sample = docs.where(F.rand(17) < 1 / every).select(F.col(text_col).alias("t"))
    # The scan stays parallel; only the sampled rows move.
    found = sample.repartition(_SAMPLE_TASKS).mapInArrow(top, "k array<string>, n array<long>").collect()
    return {k: n for row in found for k, n in zip(row["k"], row["n"], strict=True)}


def with_token_count(docs: DataFrame, model_path: str, *, text_col: str = "text", id_col: str = "doc_id", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens that the sentencepiece model gives each whole text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text_col, id_col, model_path))

    @arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = _counter(model_path, table.value)
        for batch in batches:
            yield pa.array([count(t) if t else 0 for t in batch.to_pylist()], pa.int64())

    return docs.withColumn(out_col, tokens(F.col(text_col)))


def token_counts(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, tokens and whether the tokens exceed ``limit``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = with_token_count(slim, model_path)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
