import socket
import time

import pytest

from fairlead.streaming.server import Server, accept_key

HELLO = "GET /live HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Version: 13\r\nSec-WebSocket-Key: {}\r\n\r\n"
KEY = "AAECAwQFBgcICQoLDA0ODw=="


@pytest.fixture
def server():
    running = Server(most_clients=2).start()
    running.publish(None, '{"type":"snapshot"}')
    yield running
    running.stop()


def asked(server, text):
    link = socket.create_connection(("127.0.0.1", server.port), 5)
    link.settimeout(5)
    link.sendall(text.encode() if isinstance(text, str) else text)
    return link


def rest(link):
    data = b""
    while chunk := link.recv(65536):
        data += chunk
    return data


def exactly(link, n):
    data = b""
    while len(data) < n:
        chunk = link.recv(n - len(data))
        assert chunk
        data += chunk
    return data


def received(link):
    """(opcode, payload) of the next frame."""
    head = exactly(link, 2)
    n = head[1]
    if n > 125:
        n = int.from_bytes(exactly(link, 2 if n == 126 else 8), "big")
    return head[0] & 15, exactly(link, n)


def masked(opcode, payload, last=True):
    mask = b"\x01\x02\x03\x04"
    size = bytes([0x80 | len(payload)]) if len(payload) < 126 else b"\xfe" + len(payload).to_bytes(2, "big")
    return bytes([(0x80 if last else 0) | opcode]) + size + mask + bytes(b ^ mask[k % 4] for k, b in enumerate(payload))


def joined(server):
    link = asked(server, HELLO.format(KEY))
    head = b""
    while not head.endswith(b"\r\n\r\n"):
        head += exactly(link, 1)
    assert head.startswith(b"HTTP/1.1 101") and accept_key(KEY).encode() in head
    return link


def test_the_key_of_the_standard():
    assert accept_key("dGhlIHNhbXBsZSBub25jZQ==") == "s3pPLMBiTxaQ9kYGzzhZRbK+xOo="


def test_requests(server):
    time.sleep(0.1)
    found = rest(asked(server, "GET /snapshot HTTP/1.1\r\n\r\n"))
    assert found.startswith(b"HTTP/1.1 200") and found.endswith(b'{"type":"snapshot"}')
    assert rest(asked(server, "GET /nowhere HTTP/1.1\r\n\r\n")).startswith(b"HTTP/1.1 404")
    assert rest(asked(server, "POST /live HTTP/1.1\r\n\r\n")).startswith(b"HTTP/1.1 405")
    assert rest(asked(server, HELLO.format("short"))).startswith(b"HTTP/1.1 400")
    assert rest(asked(server, "GET / HTTP/1.1\r\n" + "a: b\r\n" * 3000)).startswith(b"HTTP/1.1 431")


def test_a_client_gets_the_snapshot_then_updates(server):
    time.sleep(0.1)
    a, b = joined(server), joined(server)
    assert received(a) == (1, b'{"type":"snapshot"}') == received(b)
    assert rest(asked(server, HELLO.format(KEY))).startswith(b"HTTP/1.1 503")
    long = '{"x":"' + "y" * 70_000 + '"}'
    for text in ("one", "x" * 300, long):
        server.publish(text, text)
        assert received(a) == (1, text.encode()) == received(b)
    a.sendall(masked(9, b"still there?"))
    assert received(a) == (10, b"still there?")
    a.sendall(masked(8, (1000).to_bytes(2, "big")))
    assert received(a) == (8, (1000).to_bytes(2, "big")) and rest(a) == b""


@pytest.mark.parametrize(
    ("sent", "code"),
    [(b"\x81\x01a", 1002), (masked(3, b""), 1002), (masked(9, b"", last=False), 1002), (masked(1, b"a" * 4097), 1009), (masked(1, b"a" * 4000, last=False) + masked(0, b"a" * 200), 1009)],
)
def test_bad_frames_end_the_connection(server, sent, code):
    link = joined(server)
    received(link)
    link.sendall(sent)
    assert received(link) == (8, code.to_bytes(2, "big")) and rest(link) == b""
