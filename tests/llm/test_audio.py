import hashlib
import random
import zlib

from lotflow.llm import audio
from lotflow.runtime import table

from .conftest import SMALL


def test_round_trip_of_any_bytes():
    rng = random.Random(1)
    for n in [0, 1, 191, 192, 936, 937, 938, *[rng.randint(0, 9000) for _ in range(60)]]:
        data = rng.randbytes(n)
        stream = audio.write_stream(data, "tïtle")
        a = audio.read_stream(stream)
        assert a.data == data and a.junk == a.crc_failed == 0 and a.crc_checked == a.frames + 1 == a.table_frames + 1
        assert a.samples == 1152 * a.frames and a.rate == 48000 and a.tags["TIT2"] == "tïtle" and len(a.table) == 100
        for at in a.offsets:
            assert audio.parse_header(stream[at : at + 4])


def test_known_header():
    h = audio.parse_header(bytes([0xFF, 0xFB, 0x90, 0x64]))  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, joint stereo
    assert (h.layer, h.bitrate, h.rate, h.length, h.samples, h.side, h.protected) == (3, 128, 44100, 417, 1152, 32, False)
    assert audio.parse_header(b"\xff\xff\xff\xff") is None and audio.parse_header(b"\xff\xfb") is None


def test_damage_is_found_and_passed_over():
    rng = random.Random(2)
    for _ in range(40):
        data = rng.randbytes(6000)
        stream = audio.write_stream(data)
        a = audio.read_stream(stream)
        junk = rng.randbytes(rng.randint(1, 300)) + b"\xff\xfb\x90"
        at = rng.choice(a.offsets)
        b = audio.read_stream(stream[:at] + junk + stream[at:])
        assert b.frames == a.frames and b.junk >= len(junk) - 3
        broken = bytearray(stream)
        broken[a.offsets[-1] + 8] ^= 0x55  # side information of the last frame
        c = audio.read_stream(bytes(broken))
        assert c.crc_failed == 1 or c.junk > 0
    for n in range(200):
        audio.read_stream(random.Random(n).randbytes(n * 7))


def test_digests(spark, docs_of):
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = audio.digests(audio.text_audio(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        stream = audio.write_stream(full)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(full[-16:]), len(stream), hashlib.sha256(stream).hexdigest())
    odd = audio.digests(audio.text_audio(docs_of([(1, None, None, None), (2, "", None, None), (None, "é" * 96, None, None), (3, "x" * 3_000_000, None, None)]))).collect()
    assert sorted(r.payload_bytes for r in odd) == [192, 192, 192, 3_000_000] and len({r.feature for r in odd if r.payload_bytes == 192}) == 1
    assert audio.digests(audio.text_audio(docs.limit(0))).count() == 0
