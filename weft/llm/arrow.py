"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def pieces(batches: Iterator[pa.RecordBatch], text: str, rows: int = 256, size: int = 8_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with their texts as UTF-8 bytes: at most ``rows`` rows, and not much over ``size`` bytes
    of text unless one text alone is longer. Keeps a worker's memory bounded whatever the batch size is."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_dictionary(column.type):
            column = column.dictionary_decode()
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        at = 0
        while at < batch.num_rows:
            end, total = at, 0
            while end < batch.num_rows and end - at < rows and (end == at or total < size):
                total += len(column[end].as_buffer() or b"") if column[end].is_valid else 0
                end += 1
            yield batch.slice(at, end - at), column.slice(at, end - at).to_pylist()
            at = end


class Numbered(dict):
    """Numbers words in the order in which they are first asked for; ``fresh`` holds those that came since it was taken."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def take(self) -> list[str]:
        found, self.fresh = self.fresh, []
        return found
