"""Lines of a program's output that arrives in chunks, as a stream and as a table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators.ranks import running

#: ``final``: no chunk follows.
CHUNKS = "program string, seq long, data binary, final boolean"
LINES = "program string, line long, text string"


def cut(rest: bytes, data: bytes, final: bool) -> tuple[list[bytes], bytes]:
    """The lines that end in ``data``, which goes on from ``rest``, and the new rest. A carriage return or a line feed ends a line; empty lines are none; the last chunk ends the last line."""
    *lines, rest = re.split(rb"[\r\n]", rest + data)
    if final:
        lines, rest = [*lines, rest], b""
    return [x for x in lines if x], rest


def lines(chunks: DataFrame) -> DataFrame:
    """Lines (LINES) of a stream of chunks (CHUNKS), numbered from 0 within their program. Chunks of a program come in order of ``seq``, and are put in order within a batch. A program's
    state is the line that has not ended and a number. Bytes are decoded line by line, so a character may be cut between chunks; bytes that are none become U+FFFD. A null chunk is empty."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = (bytes(state.get[0]), state.get[1]) if state.exists else (b"", 0)
        out = []
        for e in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            found, rest = cut(rest, bytes(e.data) if e.data is not None else b"", bool(e.final))
            out += [(key[0], n + k, x.decode("utf-8", "replace")) for k, x in enumerate(found)]
            n += len(found)
        state.update((rest, n))
        yield pd.DataFrame(out, columns=["program", "line", "text"])

    return chunks.groupBy("program").applyInPandasWithState(run, LINES, "rest binary, n long", "append", GroupStateTimeout.NoTimeout)


def split_lines(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """key, line, text of a table of chunks (binary). ``line`` numbers all lines from 0, and those that are empty are left out. A chunk's first piece goes on with the line that was open
    before it, which is told by the number of line ends so far, so no chunk waits for another and a program's chunks may lie in any number of tasks. Null chunks are empty."""
    # bytes stand as characters of one byte each until a line is whole
    pieces = F.split(F.decode(F.coalesce(F.col(data), F.lit(b"")), "ISO-8859-1"), r"[\r\n]", -1)
    placed = running(chunks.select(key, F.col(order).alias("_order"), data, (F.size(pieces) - 1).alias("_ends")), [key], ["_order"], "_ends", "_begins")
    each = placed.select(F.col(key), F.col("_order"), "_begins", F.posexplode(pieces).alias("_at", "_piece")).where("_piece <> ''")
    whole = each.groupBy(key, (F.col("_begins") + F.col("_at")).alias("line")).agg(F.array_sort(F.collect_list(F.struct("_order", "_piece"))).alias("_all"))
    text = F.encode(F.array_join(F.transform("_all", lambda x: x["_piece"]), ""), "ISO-8859-1")
    return whole.select(key, "line", F.make_valid_utf8(text.cast("string")).alias("text"))
