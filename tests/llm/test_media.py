import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_cases import plain

from fairlead.llm import jpeg, media


def test_payloads_come_back_exactly():
    rng = random.Random(4)
    payloads = [media.padded(bytes(rng.choice((0, 126, 127, 128, 128, 128, 129, 255)) for _ in range(rng.randrange(2500)))) for _ in range(40)]
    payloads += [media.padded(x) for x in (b"", bytes(range(256)) * 9, b"\x80" * 5000, b"\xff" * 999, rng.randbytes(jpeg.UNIT * 9000))]
    files = jpeg.encode(payloads)
    assert [i.payload() for i in jpeg.decode(files)] == payloads
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)


def test_the_thumbnail_is_the_first_coefficient_of_each_block():
    payload = media.padded(bytes(range(256)) * 6)
    (image,) = jpeg.decode(jpeg.encode([payload]))
    assert image.thumbnail().ravel().tolist() == list(payload[::64])
    assert (image.width, image.height) == (24, 8 * len(payload) // 192)


def test_files_of_others_are_read():
    """A scan without restart markers, of a grey 16 x 8 image, written by hand: two blocks of DC 5 and 5 - 3."""
    dc = jpeg._segment(0xC4, bytes([0x00]) + bytes([0, 2, 1] + [0] * 13) + bytes([2, 3, 0]))
    ac = jpeg._segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))
    quant = jpeg._segment(0xDB, bytes([0] + [16] * 64))
    frame = jpeg._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    bits = "01" + "101" + "0" + "00" + "00" + "0"  # size 3: +5, end; size 2: -3, end
    data = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    (image,) = jpeg.decode([b"\xff\xd8" + quant + dc + ac + frame + jpeg._SOS + data + b"\xff\xd9"])
    assert image.coefficients[:, 0].tolist() == [5, 2] and not image.coefficients[:, 1:].any()
    assert image.thumbnail().tolist() == [[138, 132]]


@pytest.mark.parametrize("damage", [lambda f: f[:200], lambda f: b"xx" + f[2:], lambda f: f[:-40] + b"\xff\xd9"])
def test_damaged_files_are_refused(damage):
    (file,) = jpeg.encode([media.padded(b"hello " * 500)])
    with pytest.raises((ValueError, IndexError, KeyError)):
        jpeg.decode([damage(file)])


def test_columns(awkward, none):
    found = media.media_columns(awkward).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t in plain(awkward):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        expected.append((i, len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:])))
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == order(expected)
    by_payload = {}
    for r in found:
        assert by_payload.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.media_columns(none).count() == 0
    stored = media.media_columns(awkward.filter("doc_id = 10"), with_file=True).first()
    assert sha(stored.media) == stored.media_sha256 and len(stored.media) == stored.media_bytes
    assert np.frombuffer(stored.thumbnail, np.uint8).size == 3
