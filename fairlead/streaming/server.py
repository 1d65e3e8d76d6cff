"""A thin server of the feed: the last snapshot over HTTP, and snapshot and updates over WebSocket (RFC 6455).

It runs beside the driver, in a thread with an event loop of its own, and is told what to send by `publish`, say from
the function that `live.Live` is wrapped in. Clients are few and messages small; nothing of this is data processing.
"""

from __future__ import annotations

import asyncio
import base64
import contextlib
import hashlib
import threading
from dataclasses import dataclass, field

# Bounds of a request, of a client's message, of what waits for a client, and of clients; RFC 6455's GUID.
MOST_REQUEST, MOST_MESSAGE, MOST_QUEUED, MOST_CLIENTS = 8 * 1024, 4 * 1024, 16 * 1024 * 1024, 64
GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
TEXT, CLOSE, PING, PONG = 0x1, 0x8, 0x9, 0xA
PROTOCOL_ERROR, TOO_BIG = 1002, 1009
REQUEST_S = 10.0


class Refused(Exception):
    """A client's frame that ends the connection, with the code to close it with."""

    def __init__(self, code: int) -> None:
        super().__init__(code)
        self.code = code


def accept_key(key: str) -> str:
    return base64.b64encode(hashlib.sha1((key + GUID).encode()).digest()).decode()


def frame(opcode: int, payload: bytes) -> bytes:
    """A whole, unmasked frame, as a server sends it."""
    n = len(payload)
    size = bytes([n]) if n < 126 else b"\x7e" + n.to_bytes(2, "big") if n < 1 << 16 else b"\x7f" + n.to_bytes(8, "big")
    return bytes([0x80 | opcode]) + size + payload


async def read_frame(reader: asyncio.StreamReader) -> tuple[bool, int, bytes]:
    """(is it the last of its message, opcode, payload) of a client's frame."""
    first, second = await reader.readexactly(2)
    last, opcode, n = bool(first & 0x80), first & 0x0F, second & 0x7F
    if first & 0x70 or not second & 0x80 or opcode in (*range(3, 8), *range(11, 16)):
        raise Refused(PROTOCOL_ERROR)
    if opcode >= CLOSE and (n > 125 or not last):
        raise Refused(PROTOCOL_ERROR)
    if n > 125:
        n = int.from_bytes(await reader.readexactly(2 if n == 126 else 8), "big")
    if n > MOST_MESSAGE:
        raise Refused(TOO_BIG)
    mask = await reader.readexactly(4)
    data = await reader.readexactly(n)
    return last, opcode, bytes(b ^ mask[k % 4] for k, b in enumerate(data))


@dataclass(eq=False)
class Client:
    """What waits to be sent, and how much that is."""

    waiting: asyncio.Queue = field(default_factory=asyncio.Queue)
    queued: int = 0
    gone: bool = False

    def put(self, data: bytes) -> None:
        self.queued += len(data)
        if self.queued > MOST_QUEUED:
            self.gone = True
            self.waiting.put_nowait(b"")
        else:
            self.waiting.put_nowait(data)


class Server:
    """start, publish, stop. port 0 takes a free one, which `port` then is."""

    def __init__(self, host: str = "127.0.0.1", port: int = 0, most_clients: int = MOST_CLIENTS) -> None:
        self.host, self.port, self.most_clients = host, port, most_clients
        self.clients: set[Client] = set()
        self.snapshot = b"{}"
        self.loop = asyncio.new_event_loop()
        self.ready = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> Server:
        self.thread.start()
        self.ready.wait(10)
        return self

    def publish(self, update: str | None, snapshot: str) -> None:
        """Sends an update to all clients; the snapshot is what later ones begin with. From any thread."""
        self.loop.call_soon_threadsafe(self._publish, update, snapshot)

    def stop(self) -> None:
        self.loop.call_soon_threadsafe(self.loop.stop)
        self.thread.join(10)

    def _publish(self, update: str | None, snapshot: str) -> None:
        self.snapshot = snapshot.encode()
        if update is not None:
            data = frame(TEXT, update.encode())
            for client in list(self.clients):
                client.put(data)

    def _run(self) -> None:
        asyncio.set_event_loop(self.loop)
        server = self.loop.run_until_complete(asyncio.start_server(self._serve, self.host, self.port, limit=MOST_REQUEST))
        self.port = server.sockets[0].getsockname()[1]
        self.ready.set()
        self.loop.run_forever()
        server.close()
        for task in asyncio.all_tasks(self.loop):
            task.cancel()
        self.loop.run_until_complete(asyncio.sleep(0))
        self.loop.close()

    async def _serve(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        with contextlib.suppress(OSError, asyncio.IncompleteReadError, asyncio.TimeoutError):
            try:
                request = await asyncio.wait_for(reader.readuntil(b"\r\n\r\n"), REQUEST_S)
            except asyncio.LimitOverrunError:
                writer.write(_response(431, b""))
            else:
                await self._answer(request.decode("latin-1"), reader, writer)
            await writer.drain()
        writer.close()

    async def _answer(self, request: str, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        line, *rest = request.split("\r\n")
        method, _, target = line.partition(" ")
        path = target.split(" ")[0].split("?")[0]
        headers = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in rest)}
        if method != "GET":
            writer.write(_response(405, b""))
        elif path == "/snapshot":
            writer.write(_response(200, self.snapshot))
        elif path != "/live":
            writer.write(_response(404, b""))
        elif headers.get("upgrade", "").lower() != "websocket" or headers.get("sec-websocket-version") != "13" or not _is_key(headers.get("sec-websocket-key", "")):
            writer.write(_response(400, b""))
        elif len(self.clients) >= self.most_clients:
            writer.write(_response(503, b""))
        else:
            key = accept_key(headers["sec-websocket-key"])
            writer.write(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {key}\r\n\r\n".encode())
            await self._converse(reader, writer)

    async def _converse(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        client = Client()
        client.put(frame(TEXT, self.snapshot))
        self.clients.add(client)
        sender = asyncio.ensure_future(_send(client, writer))
        try:
            await _listen(client, reader)
        except Refused as refused:
            client.put(frame(CLOSE, refused.code.to_bytes(2, "big")))
        finally:
            self.clients.discard(client)
            client.waiting.put_nowait(b"")
            await sender


async def _send(client: Client, writer: asyncio.StreamWriter) -> None:
    with contextlib.suppress(OSError):
        while (data := await client.waiting.get()) and not client.gone:
            writer.write(data)
            await writer.drain()
            client.queued -= len(data)
    writer.close()


async def _listen(client: Client, reader: asyncio.StreamReader) -> None:
    """Answers pings and the closing frame; messages are bounded and passed over."""
    size = 0
    while True:
        last, opcode, payload = await read_frame(reader)
        if opcode == CLOSE:
            client.put(frame(CLOSE, payload[:2]))
            return
        if opcode == PING:
            client.put(frame(PONG, payload))
        elif opcode < CLOSE:
            size = size + len(payload) if opcode == 0 else len(payload)
            if size > MOST_MESSAGE:
                raise Refused(TOO_BIG)
            size = 0 if last else size


def _is_key(text: str) -> bool:
    with contextlib.suppress(ValueError):
        return len(base64.b64decode(text, validate=True)) == 16
    return False


def _response(status: int, body: bytes) -> bytes:
    reasons = {200: "OK", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 431: "Request Header Fields Too Large", 503: "Service Unavailable"}
    head = f"HTTP/1.1 {status} {reasons[status]}\r\nContent-Type: application/json\r\nContent-Length: {len(body)}\r\nConnection: close\r\n\r\n"
    return head.encode() + body
