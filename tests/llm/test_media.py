import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm.media import crc16, feature, media_index, padded, parse_header, read_payload, read_stream, text_media, write_stream


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_any_payload_comes_back(payload):
    data = write_stream(payload)
    stream = read_stream(data)
    assert read_payload(data, stream) == payload
    assert stream.skipped == 0 and stream.crc_bad == 0 and stream.resyncs == 0
    assert stream.crc_ok == len(stream.seek) + 1 == stream.table_frames + 1
    assert stream.duration == Fraction(1152 * len(stream.seek), 48000)


def test_seek_offsets_are_frame_headers():
    data = write_stream(bytes(range(256)) * 40)
    for at in read_stream(data).seek:
        assert parse_header(data[at : at + 4]) is not None


def test_resynchronises_behind_junk_and_counts_it():
    data = write_stream(b"x" * 5000)
    whole = read_stream(data)
    cut = whole.seek[3]
    damaged = read_stream(data[:cut] + b"\xff\xfbjunk\xff" + data[cut:])
    assert damaged.skipped == 7 and damaged.resyncs == 1
    assert [a - 7 * (i >= 3) for i, a in enumerate(damaged.seek)] == whole.seek


def test_a_flipped_bit_in_side_information_fails_its_checksum():
    data = bytearray(write_stream(b"x" * 3000))
    at = read_stream(bytes(data)).seek[1]
    data[at + 10] ^= 1
    stream = read_stream(bytes(data))
    assert stream.crc_bad == 1


def test_crc16_of_known_value():
    assert crc16(b"123456789") == 0xAEE7  # CRC-16 with polynomial 8005 and start FFFF


def test_headers_of_other_layers():
    layer2 = parse_header(bytes([0xFF, 0xFD, 0x84, 0xC0]))  # MPEG-1 layer II, 128 kbit/s, 48 kHz
    assert (layer2.layer, layer2.length, layer2.samples) == (2, 384, 1152)
    low = parse_header(bytes([0xFF, 0xF3, 0x84, 0xC0]))  # MPEG-2 layer III, 64 kbit/s, 24 kHz
    assert (low.version, low.samples, low.rate, low.length) == (2, 576, 24000, 192)
    assert parse_header(b"\xff\xff\xff\xff") is None


def test_what_is_no_audio():
    assert feature(read_stream(b"")) == feature(read_stream(b"no audio at all")) == "none"


def test_vbri_table():
    frame = bytearray(write_stream(b"")[: read_stream(write_stream(b"x")).seek[0]][-192:])
    frame[4:] = bytes(len(frame) - 4)
    frame[2:4] = bytes([5 << 4 | 4, 0xC0])
    head = bytes([0xFF, 0xFB]) + bytes(frame[2:4])  # unprotected
    table = b"VBRI" + bytes(6) + (960).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 1]) + b"\x01\x02\x03\x04"
    first = (head + bytes(32) + table).ljust(192, b"\0")
    second = (head + bytes(32)).ljust(192, b"\0")
    stream = read_stream(first + second + second)
    assert stream.table == "VBRI" and stream.table_frames == 2 and stream.table_toc == b"\x01\x02\x03\x04" and len(stream.seek) == 2


def test_column(spark):
    texts = [(1, None), (2, ""), (3, "é" * 200), (None, "a"), (4, "a"), (4, "a"), (5, "y" * 300_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS media", "'x' AS feature")
    rows = text_media(docs, with_media=True, with_seek=True).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        payload = read_payload(bytes(r["media"]), read_stream(bytes(r["media"])))
        assert len(payload) == r["payload_bytes"] and r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= max(192, r["n_bytes"])
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and len(r["seek"]) == r["n_frames"]
        by_text.setdefault(r["n_bytes"], set()).add((r["payload_sha256"], r["media_sha256"], r["feature"]))
    assert sorted(by_text) == [0, 1, 400, 300_000] and all(len(v) == 1 for v in by_text.values())
    assert text_media(docs.limit(0)).count() == 0
    assert padded("a" * 192)[1] == b"a" * 192
    audio = media_index(text_media(docs, with_media=True).select("doc_id", "media").unionByName(spark.createDataFrame([(9, None), (10, bytearray(b"zz"))], "doc_id long, media binary")))
    got = {r["doc_id"]: r["audio"] for r in audio.collect()}
    assert got[9]["samples"] == got[10]["samples"] == 0 and got[3]["sample_rate"] == 48000 and got[3]["tags"]["TXXX:payload_bytes"] == "576"


def layer1(mode, extension, sums=True):
    """A MPEG-1 Layer I frame of 32 kbit/s at 32 kHz with a checksum over the allocation bits of its mode."""
    head = bytes([0xFF, 0xFE, 0x18, mode << 6 | extension << 4])
    covered = {0: 32, 1: (32 + 4 * (extension + 1)) // 2, 2: 32, 3: 16}[mode]
    bits = bytes((7 * i + mode + extension) % 251 for i in range(covered))
    crc = crc16(head[2:] + bits) ^ (0 if sums else 1)
    frame = head + crc.to_bytes(2, "big") + bits
    return frame.ljust(parse_header(head).length, b"\0")


def test_layer_one_checksums_of_every_mode():
    for mode in range(4):
        for extension in range(4):
            stream = read_stream(layer1(mode, extension) * 3 + layer1(mode, extension, sums=False))
            assert (stream.crc_ok, stream.crc_bad) == (3, 1)


def test_layer_two_checksums_are_counted_as_unchecked():
    frame = bytes([0xFF, 0xFC, 0x84, 0xC0]).ljust(384, b"\0")
    stream = read_stream(frame * 3)
    assert (stream.crc_ok, stream.crc_bad, stream.crc_unchecked) == (0, 0, 3)


def test_tags_of_version_two_and_unsynchronised_tags():
    size = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    audio = write_stream(b"x")
    old = b"TT2" + (6).to_bytes(3, "big") + b"\0Title" + b"TXX" + (6).to_bytes(3, "big") + b"\0a\0bcd"
    assert {"TT2": "Title", "TXX:a": "bcd"}.items() <= read_stream(b"ID3\x02\0\0" + size(len(old)) + old + audio).tags.items()
    text = "\u00ff\u0100x".encode("utf-16")  # has FF bytes, and zeros behind them
    frame = b"TIT2" + (1 + len(text)).to_bytes(4, "big") + b"\0\0" + b"\x01" + text
    spread = frame.replace(b"\xff", b"\xff\0")
    stream = read_stream(b"ID3\x03\0\x80" + size(len(spread)) + spread + audio)
    assert stream.tags["TIT2"] == "\u00ff\u0100x" and stream.skipped == 0
    body = b"\x01" + text.replace(b"\xff", b"\xff\0")
    newer = b"TIT2" + size(len(body)) + b"\0\x02" + body
    assert read_stream(b"ID3\x04\0\0" + size(len(newer)) + newer + audio).tags["TIT2"] == "\u00ff\u0100x"


def test_encoder_delay_and_padding_are_not_audio():
    audio = write_stream(b"x" * 4000)
    frames = read_stream(audio).seek
    head = audio[frames[0] : frames[0] + 23]  # header, checksum and side information
    table = b"Info" + (15).to_bytes(4, "big") + bytes(4 + 4 + 100 + 4) + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    stream = read_stream((head + table).ljust(parse_header(head[:4]).length, b"\0") + audio[frames[0] : frames[-1]])
    assert (stream.delay, stream.padding) == (576, 1000) and stream.duration == Fraction(stream.samples - 1576, 48000)
