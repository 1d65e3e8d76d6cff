"""Line sources for Structured Streaming that can't be read again: a TCP connection and a named pipe.

One thread reads, opens anew with a growing pause and turns bytes into lines. What is held is bounded: when it is full
the oldest lines go, as a live view wants it, or the reader waits and so makes the sender wait, as a pipe does
(`when_full`: drop or wait). Lines are kept until they are committed: enough to redo a batch, not to survive the
driver. For that, put a durable log in front of it.

An offset is a number of lines since a receiver began, and that receiver's epoch. After a restart a new receiver counts
from 0 in an epoch of its own, so whatever it receives is after every offset of the old one; a batch of an old epoch that
is asked for again is empty, as its lines went with the process.
"""

from __future__ import annotations

import contextlib
import random
import socket
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from fairlead.sources.readers import MAX_PIPE_LINE, MAX_SOCKET_LINE

# Seconds to connect, of silence, and of the first and longest pause.
CONNECT_S, IDLE_S, FIRST_PAUSE_S, LONGEST_PAUSE_S = 5.0, 30.0, 0.5, 30.0
MOST_HELD = 65_536


class Framer:
    """Chunks of bytes to lines: one carriage return goes, empty lines and lines that are too long are left out."""

    def __init__(self, max_length: int = MAX_SOCKET_LINE) -> None:
        self.max_length, self.rest, self.skipping, self.too_long = max_length, b"", False, 0

    def feed(self, chunk: bytes) -> list[str]:
        *whole, self.rest = (self.rest + chunk).split(b"\n")
        lines = []
        for raw in whole:
            if self.skipping or len(raw) > self.max_length:
                self.too_long += 1
                self.skipping = False
            elif line := raw.removesuffix(b"\r"):
                lines.append(line.decode("latin-1"))
        if len(self.rest) > self.max_length:
            self.rest, self.skipping = b"", True
        return lines


def next_pause(pause: float, rng: random.Random) -> tuple[float, float]:
    """(how long to wait now, the pause after it)."""
    return pause * (0.5 + rng.random() / 2), min(LONGEST_PAUSE_S, 2 * pause)


class Held:
    """A bounded queue of numbered lines, (number, line, time of reception)."""

    def __init__(self, most: int, wait: bool) -> None:
        self.most, self.wait, self.epoch = most, wait, uuid.uuid4().hex
        self.lines: list[tuple[int, str, int]] = []
        self.next, self.dropped, self.closed = 0, 0, False
        self.changed = threading.Condition()

    def push(self, lines: list[str]) -> None:
        for line in lines:
            with self.changed:
                while self.wait and len(self.lines) >= self.most and not self.closed:
                    self.changed.wait(0.5)
                self.lines.append((self.next, line, int(time.time())))
                self.next += 1
                if len(self.lines) > self.most:
                    self.dropped += 1
                    del self.lines[0]

    def after(self, start: dict) -> int:
        """The number that an offset stands for; 0 for one of another epoch."""
        return start["next"] if start["epoch"] == self.epoch else 0

    def between(self, start: int, end: int) -> list[tuple[int, str, int]]:
        with self.changed:
            return [x for x in self.lines if start <= x[0] < end]

    def commit(self, end: int) -> None:
        with self.changed:
            self.lines = [x for x in self.lines if x[0] >= end]
            self.changed.notify_all()


class Receiver(threading.Thread):
    """Reads chunks of bytes from wherever `chunks` gets them, again and again."""

    def __init__(self, max_length: int, most: int = MOST_HELD, wait: bool = False) -> None:
        super().__init__(daemon=True)
        self.max_length, self.held, self.opened, self.stopped = max_length, Held(most, wait), 0, threading.Event()

    def chunks(self) -> Iterator[bytes]:
        raise NotImplementedError

    def run(self) -> None:
        pause, rng = FIRST_PAUSE_S, random.Random()
        while not self.stopped.is_set():
            framer = Framer(self.max_length)
            with contextlib.suppress(OSError):
                for chunk in self.chunks():
                    pause = FIRST_PAUSE_S
                    self.held.push(framer.feed(chunk))
                    if self.stopped.is_set():
                        break
            wait, pause = next_pause(pause, rng)
            self.stopped.wait(wait)

    def stop(self) -> None:
        self.held.closed = True
        self.stopped.set()


class SocketReceiver(Receiver):
    def __init__(self, host: str, port: int, max_length: int = MAX_SOCKET_LINE, most: int = MOST_HELD, wait: bool = False) -> None:
        super().__init__(max_length, most, wait)
        self.host, self.port = host, port

    def chunks(self) -> Iterator[bytes]:
        with socket.create_connection((self.host, self.port), CONNECT_S) as link:
            self.opened += 1
            link.settimeout(IDLE_S)
            while chunk := link.recv(65_536):
                yield chunk


class PipeReceiver(Receiver):
    """A named pipe, which is opened anew when its writer closes it; a file is read once for each opening."""

    def __init__(self, path: str, max_length: int = MAX_PIPE_LINE, most: int = MOST_HELD, wait: bool = True) -> None:
        super().__init__(max_length, most, wait)
        self.path = path

    def chunks(self) -> Iterator[bytes]:
        with open(self.path, "rb", buffering=0) as pipe:
            self.opened += 1
            while chunk := pipe.read(65_536):
                yield chunk


_RECEIVERS: dict[tuple, Receiver] = {}


def receiver(kind: type[Receiver], *args) -> Receiver:
    """The process's receiver of these arguments; a new one, of a new epoch, if there is none that runs."""
    key = (kind, *args)
    if key not in _RECEIVERS or not _RECEIVERS[key].is_alive():
        _RECEIVERS[key] = kind(*args)
        _RECEIVERS[key].start()
    return _RECEIVERS[key]


class LineReader(SimpleDataSourceStreamReader):
    def __init__(self, kind: type[Receiver], *args) -> None:
        self.kind, self.args = kind, args

    @property
    def held(self) -> Held:
        return receiver(self.kind, *self.args).held

    def initialOffset(self) -> dict:  # noqa: N802
        return {"epoch": "", "next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        held = self.held
        rows = held.between(held.after(start), 1 << 62)
        return iter(rows), {"epoch": held.epoch, "next": rows[-1][0] + 1} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        held = self.held
        return iter(held.between(held.after(start), end["next"]) if end["epoch"] == held.epoch else [])

    def commit(self, end: dict) -> None:
        held = self.held
        held.commit(held.after(end))


class _Lines(DataSource):
    def schema(self) -> str:
        return "seq long, line string, received_unix long"

    def _bounds(self, max_length: int, when_full: str) -> tuple[int, int, bool]:
        o = self.options
        return int(o.get("max_length", max_length)), int(o.get("most_held", MOST_HELD)), o.get("when_full", when_full) == "wait"


class TcpLines(_Lines):
    """format("tcp_lines") with options host and port; max_length, most_held, when_full (drop)."""

    @classmethod
    def name(cls) -> str:
        return "tcp_lines"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return LineReader(SocketReceiver, self.options["host"], int(self.options["port"]), *self._bounds(MAX_SOCKET_LINE, "drop"))


class PipeLines(_Lines):
    """format("pipe_lines") with option path; max_length, most_held, when_full (wait)."""

    @classmethod
    def name(cls) -> str:
        return "pipe_lines"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return LineReader(PipeReceiver, self.options["path"], *self._bounds(MAX_PIPE_LINE, "wait"))


__all__ = ["Framer", "Held", "PipeLines", "PipeReceiver", "SocketReceiver", "TcpLines", "next_pause"]
