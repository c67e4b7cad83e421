"""Chat formatting with a grammar that is read back: turns are rendered, parsed again, and escaped until they agree."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.llm.common import partitions

CHUNK_BYTES = 1 << 20
_MARK = re.compile(r"(\\*)(</?s>|\[/?INST\])")
_ESCAPED = re.compile(r"\\(\\*(?:</?s>|\[/?INST\]))")
_TURN = {"assistant": ("<s>", "</s>"), "other": ("[INST]", "[/INST]")}


def _escape(text: str) -> str:
    return _MARK.sub(r"\\\1\2", text)


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the text in the formatted string) of each turn; None if it is not of the grammar.

    A turn is a mark, the role, a newline, the text, a newline and the closing mark. A mark after a backslash is text.
    """
    turns, open_at, closing = [], None, None
    for m in _MARK.finditer(formatted):
        if m[1]:
            continue
        if open_at is None:
            if m[2] not in ("<s>", "[INST]") or m.start(2) != (turns[-1][4] if turns else 0):
                return None
            open_at, closing = m.end(), "</s>" if m[2] == "<s>" else "[/INST]"
        elif m[2] != closing:
            return None
        else:
            head = formatted.find("\n", open_at, m.start())
            if head < 0 or formatted[m.start() - 1] != "\n" or head + 1 > m.start() - 1:
                return None
            role = _unescape(formatted[open_at:head]).replace("\\n", "\n").replace("\\b", "\\")
            turns.append((role, _unescape(formatted[head + 1 : m.start() - 1]), head + 1, m.start() - 1, m.end()))
            open_at = None
    if open_at is not None or (turns[-1][4] if turns else 0) != len(formatted):
        return None
    return [t[:4] for t in turns]


def render(role: str, text: str) -> str:
    """One turn; its text stays as it is if it reads back so, else its marks get a backslash each."""
    left, right = _TURN["assistant" if role == "assistant" else "other"]
    head = _escape(role.replace("\\", "\\b").replace("\n", "\\n"))
    for body in (text, _escape(text)):
        out = f"{left}{head}\n{body}\n{right}"
        got = parse(out)
        if got is not None and len(got) == 1 and got[0][:2] == (role, text):
            return out
    raise ValueError("a turn cannot be read back")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start and loss_end (code points in formatted; null outside the loss mask).

    The loss mask holds the texts of assistant turns. A conversation's formatted string is that of its turns, joined
    without a break, in order of turn, role and text. Null roles and texts count as empty. Repeated rows stay, null ids
    and turns too (first in order); an empty table gives an empty result; other columns are not read.
    """

    def rendered(batches):
        for batch in batches:
            out, start, end = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out.append(render(role, text))
                _, _, a, b = parse(out[-1])[0]
                start.append(a if role == "assistant" else None)
                end.append(b if role == "assistant" else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array(out, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"],
            )

    source = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    return source.mapInArrow(rendered, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation, from the formatted turns alone: counts and digests of turns and of the loss mask.

    Turns are dealt into ranges of (conv_id, turn), so that a long conversation is spread. There the formatted turns are
    joined into chunks of about CHUNK_BYTES, which end between turns, and each chunk is parsed as one string; the loss
    is what the mask's code points hold in it. Only the digests, which go on from one byte to the next, run over a
    conversation's chunks in order. Repeated rows count as often as they stand; an empty table gives an empty result.
    """
    order = ["conv_id", "turn", "role", "text"]
    n = partitions(formatted)
    ranged = formatted.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def chunks(batches):
        def row():
            whole = "".join(t[0] for t in held)
            turns = parse(whole)
            if turns is None:
                raise ValueError(f"conversation {now} cannot be read back")
            said = b"".join(b"%s\n%s\n" % (role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")) for role, text, _, _ in turns)
            loss, at = [], 0
            for out, first, last in held:  # the mask's code points of the chunk, whatever its turns are
                if first is not None:
                    loss.append(_unescape(whole[at + first : at + last]))
                at += len(out)
            loss = "".join(loss)
            return pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([now], pa.int64()), "part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int64()), "n_turns": pa.array([len(turns)], pa.int64()),
                    "turns": pa.array([said], pa.binary()), "loss": pa.array([loss.encode("utf-8", "surrogatepass")], pa.binary()), "loss_chars": pa.array([len(loss)], pa.int64()), "formatted_chars": pa.array([len(whole)], pa.int64()),
                }
            )

        now = part = None
        nth, size, held = 0, 0, []
        for batch in batches:
            for key, p, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_start", "loss_end")), strict=True):
                if held and (key != now or size >= CHUNK_BYTES):
                    yield row()
                    nth = nth + 1 if key == now else 0
                    size, held = 0, []
                now, part = key, p
                held.append(turn)
                size += len(turn[0])
        if held:
            yield row()

    pieces = ranged.select("conv_id", "part", "formatted", "loss_start", "loss_end").mapInArrow(
        chunks, "conv_id long, part int, nth long, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"
    )
    dealt = pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "nth")

    def digests(batches):
        now, any_row, sums, said, loss = None, False, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
        names = ("n_turns", "loss_chars", "formatted_chars")

        def row():
            return pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([now], pa.int64()), "n_turns": pa.array([sums[0]], pa.int64()), "turns_sha256": [said.hexdigest()], "loss_chars": pa.array([sums[1]], pa.int64()),
                    "loss_sha256": [loss.hexdigest()], "formatted_chars": pa.array([sums[2]], pa.int64()),
                }
            )

        for batch in batches:
            for r in batch.to_pylist():
                if any_row and r["conv_id"] != now:
                    yield row()
                    sums, said, loss = [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                now, any_row = r["conv_id"], True
                sums = [s + r[c] for s, c in zip(sums, names, strict=True)]
                said.update(r["turns"])
                loss.update(r["loss"])
        if any_row:
            yield row()

    return dealt.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
