from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import media
from symloom.llm.media import FRAME, clip_rows, cuts, decode_frames, media_digests, payload_of, read_avi, read_header, store, text_to_avi


def test_every_byte_comes_back():
    rng = np.random.default_rng(0)
    for payload in (bytes(range(192)), bytes(192), b"\xff" * 384, rng.integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()):
        movie = read_avi(store(payload))
        assert decode_frames(movie.frames).tobytes() == payload and movie.fps == 10


def test_general_decoder_agrees():
    payload = np.random.default_rng(1).integers(0, 256, FRAME, dtype=np.uint8)
    frame = read_avi(store(payload.tobytes())).frames[0]
    t = read_header(frame)
    pixels = media._decode_scan(frame[t.scan : -2], t)[0]
    assert (pixels.reshape(FRAME, 8, 8) == payload[:, None, None]).all() and t.blocks == FRAME and t.field == 10


def bits(parts):
    text = "".join(parts)
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_frames_with_other_tables_and_restarts():
    # categories 0, 3 and 4 have two-bit codes; AC: end of block 0, (run 0, size 2) 10
    dc, ac = [(2, 0), (2, 3), (2, 4)], [(1, 0), (2, 2)]
    head = b"".join([b"\xff\xd8", media._marker(0xDB, b"\x00" + bytes([8] + [16] * 63)), media._marker(0xC0, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0])), media._marker(0xC4, media._huffman(0, dc) + media._huffman(16, ac)), media._marker(0xDD, b"\x00\x02"), media._marker(0xDA, bytes([1, 1, 0, 0, 63, 0]))])
    first = bits(["01" + "101" + "0", "01" + "010" + "10" + "11" + "0"])  # dc 5; then 5-5=0 with a first ac of 3
    second = bits(["10" + "1001" + "0"])  # dc 9 after the restart
    frame = head + first + b"\xff\xd0" + second + b"\xff\xd9"
    t = read_header(frame)
    assert t.field == 0 and t.restart == 2 and t.blocks == 3
    values = decode_frames([frame])
    assert values[0].tolist() == [133, 128, 137]
    pixels = media._decode_scan(frame[t.scan : -2], t)[0][0, 1]
    assert pixels[0, 0] > 128 > pixels[0, 7] and (pixels[0] == pixels[7]).all()


def test_odd_files():
    data = store(bytes(384))
    cut = data[: data.index(b"idx1")]
    assert len(read_avi(cut).frames) == 2
    with pytest.raises(ValueError):
        read_avi(b"nothing")


def encoded(values, table):
    """Bits of differences (DC) and an end of block each, by a Huffman table."""
    codes, out, before = {s: (n, c) for (n, c), s in table[0].items()}, [], 0
    end = {s: (n, c) for (n, c), s in table[1].items()}[0]
    for v in values:
        d, before = v - before, v
        k = abs(d).bit_length()
        n, c = codes[k]
        out.append(format(c, f"0{n}b") + (format(d if d >= 0 else d + (1 << k) - 1, f"0{k}b") if k else "") + format(end[1], f"0{end[0]}b"))
    return out


def test_standard_tables_are_whole():
    for (kind, _), table in media.STANDARD.items():
        assert len(set(table.values())) == len(table) == (162 if kind else 12)
        assert sum(2 ** (16 - n) for n, _ in table) < 1 << 16  # prefix codes, without the code of ones


def test_colour_frames_without_tables():
    """Two units of four luma blocks, one blue and one red block each, as cameras write them."""
    light, tint = (media.STANDARD[0, 0], media.STANDARD[1, 0]), (media.STANDARD[0, 1], media.STANDARD[1, 1])
    luma, blue, red = [10, 20, -30, 40, -50, 60, 0, 5], [12, -7], [-20, 30]
    y, cb, cr = encoded(luma, light), encoded(blue, tint), encoded(red, tint)
    scan = bits([*y[:4], cb[0], cr[0], *y[4:], cb[1], cr[1]])
    head = b"".join([b"\xff\xd8", media._marker(0xE0, b"AVI1"), media._marker(0xDB, b"\x00" + bytes([8] * 64)), media._marker(0xDB, b"\x01" + bytes([16] * 64)), media._marker(0xC0, bytes([8, 0, 16, 0, 30, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])), media._marker(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))])
    frame = head + scan + b"\xff\xd9"
    t = read_header(frame)
    assert (t.width, t.height, t.blocks, len(t.components)) == (30, 16, 8, 3)
    # a unit's blocks are two rows of two
    assert decode_frames([frame])[0].tolist() == [128 + v for v in (10, 20, -50, 60, -30, 40, 0, 5)]
    rgb = media.frame_pixels(frame)
    assert rgb.shape == (16, 30, 3)
    want = np.rint([138 - 40 * 1.402, 138 - 24 * 0.344136 + 40 * 0.714136, 138 + 24 * 1.772])
    assert (rgb[0, 0] == want).all() and (rgb[7, 7] == want).all()
    movie = read_avi(media.write_avi([frame, frame], 30, 16, 25))
    assert movie.fps == 25 and movie.frames == [frame, frame]


def test_broken_files_have_errors(spark):
    good = store(bytes(range(192)) * 3)
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2")
    rng = np.random.default_rng(7)
    files = [good, None, b"", b"RIFF", b"nothing at all, but long enough", good[:60], good[:400], good[: len(good) // 2], progressive]
    for _ in range(150):
        own = bytearray(good)
        for at in rng.integers(0, len(own), 6):
            own[at] = rng.integers(0, 256)
        files.append(bytes(own))
    df = spark.createDataFrame(list(enumerate(files)), "i long, f binary").select("i", "f", media.read_media(F.col("f")).alias("r"))
    got = {r["i"]: r["r"] for r in df.collect()}
    assert got[0]["error"] is None and got[0]["n_frames"] == 3 and got[1] is None
    for i in (2, 3, 4, 5, 8):
        assert got[i]["error"] and got[i]["payload_bytes"] is None and got[i]["media_bytes"] == len(files[i])
    rows = clip_rows(df, "i", "f").collect()
    assert {r["i"] for r in rows} == {i for i, r in got.items() if r is not None and r["n_frames"]}


def test_frames_of_other_sizes():
    small, large = np.full(12, 10), np.full(48, 10)
    assert cuts([small, large, small, np.full(48, 200)]) == [3]


def test_cuts_follow_histograms():
    calm = np.full((6, FRAME), 40)
    calm[:, :5] += np.arange(6)[:, None]
    other = np.full((6, FRAME), 200)
    calm[1:3, :10] = 90
    assert cuts(np.concatenate([calm, other])) == [6]
    assert cuts(calm[:1]) == [] and cuts(np.zeros((0, FRAME))) == []


def test_first_boundary_can_be_a_cut():
    dark, light = np.full((1, FRAME), 10), np.full((5, FRAME), 200)
    assert cuts(np.concatenate([dark, light[:1]])) == [1]
    assert cuts(np.concatenate([dark, light])) == [1]
    assert cuts(light[:2]) == [] and cuts(light) == []


def test_query(docs, rows, empty):
    got = media_digests(docs).collect()
    want = sorted((r[0], hashlib.sha256(payload_of(r[1])).hexdigest()) for r in rows if r[0] is not None)
    assert sorted((r["doc_id"], r["payload_sha256"]) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["payload_bytes"], r["tail_crc32"]))
    assert all(len(v) == 1 for v in by.values())
    one = next(r for r in got if r["doc_id"] == 94)
    text = next(r[1] for r in rows if r[0] == 94)
    assert one["n_bytes"] == len(text.encode()) and one["tail_crc32"] == zlib.crc32(payload_of(text)[-16:]) and one["media_bytes"] == len(store(payload_of(text)))
    assert media_digests(empty).collect() == []


def test_clip_rows(docs, empty):
    files = docs.where("doc_id < 95").select("doc_id", text_to_avi(docs["text"]).alias("avi"))
    got = clip_rows(files, "doc_id", "avi").where("doc_id = 94").orderBy("clip").collect()
    assert got[0]["first_frame"] == 0 and all(b["first_frame"] == a["first_frame"] + a["n_frames"] for a, b in zip(got, got[1:], strict=False))
    assert all(r["end_s"] > r["start_s"] for r in got)
    assert clip_rows(empty.select("doc_id", text_to_avi(empty["text"]).alias("avi")), "doc_id", "avi").collect() == []


def parts_of_avi(frames, per, indexed=True, lists=False, stray=False):
    """A large AVI file: several RIFF parts, an index of indexes, the video as the second stream."""
    plain = store(bytes(192))
    head = plain[12 : plain.index(b"movi") - 8]
    strl = head[head.index(b"strl") - 8 :]
    audio = media._list(b"strl", media._chunk(b"strh", b"auds" + bytes(52)))
    groups = [frames[i : i + per] for i in range(0, len(frames), per)]

    def movie(group, at):
        """A part's list with sound between the frames, and its index chunk at the end."""
        body, places = b"", []
        for f in group:
            body += media._chunk(b"00wb", b"sound")
            places.append((at + 12 + len(body) + 8, len(f)))
            c = media._chunk(b"01dc", f)
            if lists:
                c = media._list(b"rec ", c)
                places[-1] = (places[-1][0] + 12, len(f))
            body += c
        ix = media.struct.pack("<HBBI4sQI", 2, 0, 1, len(group), b"01dc", at, 0) + b"".join(media.struct.pack("<II", a - at, n | 1 << 31) for a, n in places)
        return media._list(b"movi", body + (media._chunk(b"ix01", ix) if indexed else b"")), at + 12 + len(body)

    def whole(entries):
        indx = media.struct.pack("<HBBI4s12x", 4, 0, 0, len(entries), b"01dc") + b"".join(media.struct.pack("<QII", a, n, 1) for a, n in entries)
        own = media._list(b"strl", strl[12:] + (media._chunk(b"indx", indx) if indexed and not stray else b""))
        hdrl = media._list(b"hdrl", audio + own)
        out, places = b"", []
        for k, group in enumerate(groups):
            before = len(out) + 12 + (len(hdrl) if k == 0 else 0)
            m, ix = movie(group, before)
            places.append((ix, 24 + 8 * len(group)))
            body = (b"AVI " + hdrl if k == 0 else b"AVIX") + m
            out += b"RIFF" + media.struct.pack("<I", len(body)) + body
        return out, places

    _, places = whole([(0, 0)] * len(groups))
    return whole(places)[0]


@pytest.mark.parametrize("kind", [{}, {"indexed": False}, {"indexed": False, "lists": True}, {"stray": True}, {"lists": True}])
def test_files_of_several_parts(kind):
    """Every frame of every part comes, by indexes and without them, also from lists of records."""
    frames = read_avi(store(bytes(range(192)) * 12)).frames
    assert read_avi(parts_of_avi(frames, 5, **kind)).frames == frames


def test_index_beyond_the_file_is_an_error():
    frames = read_avi(store(bytes(range(192)) * 12)).frames
    data = parts_of_avi(frames, 5)
    with pytest.raises(ValueError, match="outside"):
        read_avi(data[: len(data) - 600])
    one = store(bytes(384))
    at = one.index(b"idx1") + 8 + 16
    with pytest.raises(ValueError, match="outside"):
        read_avi(one[: at + 8] + media.struct.pack("<I", 1 << 30) + one[at + 12 :])
