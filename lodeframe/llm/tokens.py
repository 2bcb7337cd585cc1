"""Token counts of whole texts, by the tokenizers library, without keeping any token."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeframe.llm.common import LOWER, by_bytes, utf8_texts

#: Bytes of text handed to the library at once.
BATCH_BYTES = 1 << 20
#: Distinct pieces whose counts a Python worker remembers before it starts afresh.
CACHE_PIECES = 400_000
#: Pieces joined to one string for the library.
JOINED = 256
#: A symbol with one token of its own, put between joined pieces.
MARK = "★"

_TAIL = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""


def piece_counter(path: str, cache_pieces: int = CACHE_PIECES) -> Callable[[list[bytes]], list[int]]:
    """A function from texts (UTF-8) to their token counts by the tokenizer file at `path`.

    Texts are split where the tokenizer itself always splits: at ASCII white space, and between a
    letter and the ASCII punctuation that ends a word. Pieces repeat far more than texts do, so
    only new distinct pieces reach the library, joined by a marker token of known id. Texts that
    hold the marker, a special token's opening or combining marks go to the library whole.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    mark = tok.encode(MARK, add_special_tokens=False).ids
    joinable = len(mark) == 1
    mark_id, mark_bytes = mark[-1], MARK.encode()
    counts: dict[bytes, int] = {}

    def whole(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(pieces: list[bytes]) -> None:
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            joined = [(b" %b " % mark_bytes).join(g).decode() + f" {MARK}" for g in some]
            for group, e in zip(some, tok.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ends = np.flatnonzero(np.array(e.ids) == mark_id)
                counts.update(zip(group, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))

    def count(texts: list[bytes]) -> list[int]:
        out, plain, odd = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            simple = joinable and not (b"<|" in text or b"\xcc" in text or b"\xcd" in text or mark_bytes in text)
            (plain if simple else odd).append(i)
        words = {i: texts[i].translate(LOWER).split() for i in plain}
        if len(counts) > cache_pieces:
            counts.clear()
        fresh = set().union(*words.values()) - counts.keys() if words else set()
        cores, cut = set(), []
        for w in fresh:
            core = w.rstrip(_TAIL)
            if core != w and core[-1:].isalpha():
                tail = w[len(core) :]
                cores.update((core, tail))
                cut.append((w, core, tail))
            else:
                cores.add(w)
        learn(sorted(cores - counts.keys()))
        counts.update([(w, counts[core] + counts[tail]) for w, core, tail in cut])
        for i in plain:
            out[i] = sum(map(counts.__getitem__, words[i]))
        for i, n in zip(odd, whole([texts[i].decode() for i in odd]), strict=True):
            out[i] = n
        return out

    return count


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    context: int = 2048,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_tokens, over_limit (n_tokens > context).

    Null and empty texts have 0 bytes and 0 tokens. Texts of any length are counted whole.
    Repeated rows give repeated rows; a null id stays null; other columns of `docs` are not read,
    so their names don't matter. `tokenizer` is the path of a tokenizers .json file on every node.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = piece_counter(tokenizer)
        for batch in batches:
            texts = list(utf8_texts(batch.column(1)))
            n_tokens: list[int] = []
            for a, b in by_bytes(texts, batch_bytes):
                n_tokens += count(texts[a:b])
            n_tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    n_tokens,
                    pa.compute.greater(n_tokens, context),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    import pyarrow.compute  # noqa: F401  (the closure uses pa.compute)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
