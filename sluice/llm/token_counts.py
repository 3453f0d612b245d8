"""Token counts of whole documents, huge ones by overlap resynchronisation.

A text of up to `chunk_chars` characters is counted in one piece.  Where the tokenizer's
file says that it joins nothing across white space, and drops that, each
white-space-free part is encoded once per worker and its count reused.  A longer text is cut into overlapping chunks,
each encoded with offsets.  Two neighbours are spliced where, within their
overlap, both have the same run of tokens at the same offsets, starting just
after white space: what follows such a boundary is encoded alike whatever
precedes it.  Where none is found, the overlap is doubled, up to the whole rest, and
what is new grows with it: a text without any boundary is encoded a few times in all.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm._store import bounded_batches
from sluice.llm._worker import held

#: White space to `str.split()` but not to the tokenizer's patterns; such texts are encoded without the cache.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Parts remembered by one worker.
CACHE = 250_000
#: Longer parts are encoded but not remembered.
LONGEST = 64


def load_tokenizer(path: str):
    """The tokenizer of a .json file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splits_at_space(path: str) -> bool:
    """Whether the file's pattern takes white space out, so that the text's white-space-free parts have the tokens that the text has."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = file.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers") or [steps]
    first = steps[0]
    found = [t.get("content", "") for t in file.get("added_tokens") or []]
    out = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in (first.get("pattern") or {}).get("Regex", "")
    plain = all(not s.get("add_prefix_space") and not (s.get("type") == "ByteLevel" and s.get("use_regex")) for s in steps)
    return bool((out or first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")) and plain and not any(re.search(r"\s", t) for t in found))


class PartCounter:
    """Counts tokens of texts, by white-space-free parts where that is right, each encoded once while it is remembered."""

    def __init__(self, tokenizer, by_parts: bool = True):
        self.tokenizer, self.known, self.by_parts = tokenizer, {}, by_parts

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_parts:
            return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out, waiting, missing = [0] * len(texts), [], set()
        get = self.known.get
        for i, text in enumerate(texts):
            parts = text.split()
            found = list(map(get, parts))
            if None in found:
                missing.update(p for p, c in zip(parts, found, strict=True) if c is None)
                waiting.append((i, parts))
            else:
                out[i] = sum(found)
        if waiting:
            parts = list(missing)
            new = dict(zip(parts, map(len, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)), strict=True))
            if len(self.known) < CACHE:
                self.known.update((p, c) for p, c in new.items() if len(p) <= LONGEST)
            for i, parts in waiting:
                out[i] = sum(c if (c := get(p)) is not None else new[p] for p in parts)
        return out


def spliced(tokenizer, text: str, chunk: int, overlap: int, agree: int = 4) -> tuple[list[int], list[tuple[int, int]]]:
    """Token ids and offsets of a text, encoded in overlapping chunks.

    `agree` tokens in a row must have the same ids and offsets in both chunks, the
    first of them beginning a line or word after white space.
    """

    def encode(a: int, b: int):
        e = tokenizer.encode(text[a:b], add_special_tokens=False)
        return e.ids, [(x + a, y + a) for x, y in e.offsets]

    chunk = max(chunk, 2 * overlap, 2)
    to = min(len(text), chunk)
    ids, places = encode(0, to)
    while to < len(text):
        width = overlap
        while True:
            start = max(0, to - width)
            until = min(len(text), max(start + chunk, to + width))
            new_ids, new_places = encode(start, until)
            at = {p: i for i, p in enumerate(new_places)}
            splice = None
            for i in range(len(ids) - agree, -1, -1):
                a = places[i][0]
                if a <= start:
                    break
                j = at.get(places[i])
                if j is None or not j or not text[a - 1].isspace() or _ODD_SPACE.match(text[a - 1]):
                    continue
                if places[i + agree - 1][1] < to and ids[i : i + agree] == new_ids[j : j + agree] and places[i : i + agree] == new_places[j : j + agree]:
                    splice = i, j
                    break
            if splice:
                i, j = splice
                ids[i:], places[i:] = new_ids[j:], new_places[j:]
                break
            if start == 0:
                ids, places = new_ids, new_places
                break
            width *= 2
        to = until
    return ids, places


def _batches(path: str, id_col: str, text_col: str, limit: int, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("counts", path), lambda: PartCounter(load_tokenizer(path), splits_at_space(path)))
        tokenizer = counter.tokenizer
        for batch in batches:
            ids, column = batch.column(id_col), batch.column(text_col)
            for at in range(0, len(column), 256):
                texts = [t or "" for t in column.slice(at, 256).to_pylist()]
                plain = [i for i, t in enumerate(texts) if len(t) <= chunk and not _ODD_SPACE.search(t)]
                counts = [0] * len(texts)
                for i, c in zip(plain, counter.counts([texts[i] for i in plain]), strict=True):
                    counts[i] = c
                for i in set(range(len(texts))) - set(plain):
                    counts[i] = len(spliced(tokenizer, texts[i], chunk, overlap)[0])
                sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield pa.record_batch([ids.slice(at, 256), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 65_536, overlap_chars: int = 1_024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, without begin, end or added special tokens.

    Null and empty texts have 0 bytes and 0 tokens.  A null id stays null; repeated
    rows are counted one by one; other columns are left out, whatever their names.  An
    empty table gives no row.  No shuffle.
    """
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(_batches(tokenizer_path, id_col, text_col, limit, chunk_chars, overlap_chars), schema)
