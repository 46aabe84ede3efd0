"""Command streams: parsing of pipelined requests, and reply texts, as data for command logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_ARGS, MAX_BULK, MAX_INLINE = 1 << 20, 512 << 20, 64 << 10


class ProtocolError(ValueError):
    pass


def commands(data: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Each complete command at the start of the data, with the bytes taken up to its end; what
    follows the last one is incomplete. Raises ProtocolError where no continuation could be valid,
    after the commands before that place."""
    at = 0
    while at < len(data):
        got = _array(data, at) if data[at : at + 1] == b"*" else _inline(data, at)
        if got is None:
            return
        args, at = got
        yield args, at


def parse(data: bytes) -> tuple[list[list[bytes]], int]:
    """Complete commands at the start of the data and the bytes they take; see commands()."""
    got = list(commands(data))
    return [args for args, _ in got if args], got[-1][1] if got else 0


def _line(data: bytes, at: int) -> tuple[bytes, int] | None:
    end = data.find(b"\r\n", at)
    return None if end < 0 else (data[at:end], end + 2)


def _number(text: bytes, what: str, low: int, high: int) -> int:
    digits = text[1:] if text[:1] == b"-" else text
    if not digits.isdigit() or not low <= int(text) <= high:
        raise ProtocolError(f"invalid {what} length")
    return int(text)


def _array(data: bytes, at: int) -> tuple[list[bytes], int] | None:
    head = _line(data, at)
    if head is None:
        return None
    count, at = _number(head[0][1:], "multibulk", 1, MAX_ARGS), head[1]
    args = []
    for _ in range(count):
        if at >= len(data):
            return None
        if data[at : at + 1] != b"$":
            raise ProtocolError("expected '$'")
        head = _line(data, at)
        if head is None:
            return None
        size, at = _number(head[0][1:], "bulk", 0, MAX_BULK), head[1]
        if len(data) - at < size + 2:
            return None
        if data[at + size : at + size + 2] != b"\r\n":
            raise ProtocolError("bulk string not terminated by CRLF")
        args.append(data[at : at + size])
        at += size + 2
    return args, at


def _inline(data: bytes, at: int) -> tuple[list[bytes], int] | None:
    end = data.find(b"\n", at)
    if end < 0:
        if len(data) - at > MAX_INLINE:
            raise ProtocolError("inline command too long")
        return None
    return [x for x in data[at:end].removesuffix(b"\r").split(b" ") if x], end + 1


def reply(value: object) -> bytes:
    """Reply bytes: None, int, bytes, list, ("ok", text) or ("error", text)."""
    if value is None:
        return b"$-1\r\n"
    if isinstance(value, int):
        return b":%d\r\n" % value
    if isinstance(value, bytes):
        return b"$%d\r\n%s\r\n" % (len(value), value)
    if isinstance(value, tuple):
        return (b"+" if value[0] == "ok" else b"-") + str(value[1]).encode() + b"\r\n"
    return b"*%d\r\n%s" % (len(value), b"".join(reply(v) for v in value))


def parse_frame(streams: DataFrame) -> DataFrame:
    """(client, pos, args, error) of rows (client, data): one row per command. Commands before a
    protocol error are kept; the error ends its stream, with a row that names it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for client, data in zip(b["client"], b["data"], strict=True):
                k = 0
                try:
                    for args, _ in commands(bytes(data)):
                        if args:
                            rows.append((client, k, args, None))
                            k += 1
                except ProtocolError as e:
                    rows.append((client, k, None, str(e)))
            yield pd.DataFrame(rows, columns=["client", "pos", "args", "error"])

    return streams.select("client", "data").mapInPandas(run, "client string, pos bigint, args array<binary>, error string")
