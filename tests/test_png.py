"""PNG files of every kind against a plain decoder, and pictures of a document to crops and manifests."""

import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest

from tallgrass.__main__ import main
from tallgrass.sources import files, images, png


def filtered(rows, step, rng):
    """Rows of bytes with a random filter each, as the format says it, byte by byte."""
    out, above = bytearray(), [0] * len(rows[0])
    for row in rows:
        kind = int(rng.integers(0, 5))
        out.append(kind)
        for i, value in enumerate(row):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            guess = left + up - corner
            near = min((abs(guess - v), k) for k, v in enumerate((left, up, corner)))[1]
            out.append((value - (0, left, up, (left + up) // 2, (left, up, corner)[near])[kind]) % 256)
        above = row
    return bytes(out)


def packed_rows(values, depth):
    """values: height x numbers of ``depth`` bits."""
    out = []
    for row in values:
        bits = "".join(format(int(v), f"0{depth}b") for v in row)
        bits += "0" * (-len(bits) % 8)
        out.append([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)])
    return out


def made(values, depth, colour, rng, palette=None, interlaced=False):
    height, width, channels = values.shape
    step = max(1, channels * depth // 8)
    parts = [values[y::dy, x::dx] for x, y, dx, dy in png.PASSES] if interlaced else [values]
    stream = b"".join(filtered(packed_rows(p.reshape(p.shape[0], -1), depth), step, rng) for p in parts if p.size)
    piece = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    squeezed = zlib.compress(stream)
    pieces = [piece(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced)))]
    pieces += [piece(b"PLTE", palette.tobytes())] if palette is not None else []
    pieces += [piece(b"IDAT", squeezed[:20]), piece(b"IDAT", squeezed[20:]), piece(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(pieces)


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_every_kind(colour, depth, interlaced):
    rng = np.random.default_rng(colour * 100 + depth)
    for height, width in ((1, 1), (3, 5), (13, 9)):
        values = rng.integers(0, 1 << depth, (height, width, png.CHANNELS[colour]))
        palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if colour == 3 else None
        got = png.read_png(made(values, depth, colour, rng, palette, interlaced))
        if colour == 3:
            want = palette[values[:, :, 0]]
        else:
            scaled = values >> 8 if depth == 16 else values * 255 // ((1 << depth) - 1)
            want = scaled[:, :, :3] if scaled.shape[2] >= 3 else np.repeat(scaled[:, :, :1], 3, axis=2)
        assert np.array_equal(got, want)


def test_broken_files():
    whole = png.write_png(np.full((4, 6, 3), 200, np.uint8))
    assert np.array_equal(png.read_png(whole), np.full((4, 6, 3), 200))
    for data in (b"", b"GIF89a", whole[:30], whole[:-20], whole[:50] + b"\x00" + whole[51:], whole[:8]):
        with pytest.raises(ValueError):
            png.read_png(data)
        assert images.read_answer(data) is None


def boxed(height, width, boxes, tail=False):
    out = np.full((height, width, 3), 255, np.uint8)
    for top, bottom in boxes:
        out[top : bottom + 1, 2 : width - 2] = images.GREEN[0]
        out[top + 2 : bottom - 1, 4 : width - 4] = 255
    if tail:
        out[-12:-2, 5:25] = images.GREEN[0]
    return out


def test_document_to_manifests(spark, tmp_path):
    shown = {"a.png": boxed(120, 100, [(10, 40)], True), "b.png": boxed(200, 100, [(10, 40), (80, 110)]), "c.png": np.full((50, 60, 3), 255, np.uint8), "d.png": boxed(100, 100, [], True)}
    w, r = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    paragraph = lambda text, ids: f"<w:p><w:r><w:t>{text}</w:t></w:r>{''.join(f'<w:r><w:drawing r:embed=%s/></w:r>' % chr(34).join(['', i, '']) for i in ids)}</w:p>"
    body = paragraph("No picture", []) + paragraph("First  question", ["r0", "r1"]) + paragraph("Second", ["r1"]) + paragraph("", ["r2"]) + paragraph("Ticks", ["r3"]) + paragraph("Broken", ["r4"])
    relations = "".join(f'<Relationship Id="r{i}" Type="x/image" Target="media/{n}"/>' for i, n in enumerate([*shown, "e.png"]))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {w} {r}><w:body>{body}</w:body></w:document>")
        archive.writestr("word/_rels/document.xml.rels", f"<Relationships>{relations}</Relationships>")
        for name, picture in shown.items():
            archive.writestr(f"word/media/{name}", png.write_png(picture))
        archive.writestr("word/media/e.png", b"no picture")
    path = str(tmp_path / "a.docx")
    (tmp_path / "a.docx").write_bytes(held.getvalue())
    answers = images.answer_pictures(files.read_docx(spark, path), files.read_docx_pictures(spark, path))
    got = {x.i: (x.question, x.media, x.cls, x.width, x.height) for x in answers.collect()}
    assert got == {0: ("First question", "word/media/a.png", "GREEN_VERIFIED", 100, 120), 1: ("Second", "word/media/b.png", "MULTI_ANSWER", 100, 200), 2: ("", "word/media/c.png", "NO_MARK", 60, 50), 3: ("Ticks", "word/media/d.png", "GREEN_TICK_ONLY", 100, 100), 4: ("Broken", "word/media/e.png", None, None, None)}
    crops = images.crop_manifest(answers).collect()
    assert sorted((c.i, c.k, c.crop) for c in crops) == [(0, "0", "a000_0.png"), (1, "0", "a001_0.png"), (1, "1", "a001_1.png"), (3, "full", "full003.png")]
    for c in crops:
        own = png.read_png(bytes(c.png))
        assert np.array_equal(own, shown["d.png"]) if c.k == "full" else (own == 255).all() and own.shape[1] == 86
    assert sorted((p.i, p.cls, p.size) for p in images.pending_manifest(answers).collect()) == [(0, "GREEN_VERIFIED", [100, 120]), (1, "MULTI_ANSWER", [100, 200]), (3, "GREEN_TICK_ONLY", [100, 100])]
    assert {(t.name, t.whole) for t in images.transcription_names(images.crop_manifest(answers)).collect()} == {("0_0", False), ("1_0", False), ("1_1", False), ("3_full", True)}

    work = tmp_path / "work"
    work.mkdir()
    assert main(["extract", path, str(work)], spark) == 0
    assert [(c["i"], c["k"], c["crop"]) for c in json.loads((work / "crops.json").read_text())] == [(0, "0", "a000_0.png"), (1, "0", "a001_0.png"), (1, "1", "a001_1.png"), (3, "full", "full003.png")]
    assert [p["i"] for p in json.loads((work / "pending.json").read_text())] == [0, 1, 3] and spark.read.parquet(str(work / "crops.parquet")).count() == 4
    told = {"0": " one  answer", "1_1": "b", "1_0": "a", "3_full": [{"question": "Which?", "answer": "x"}, {"question": "", "answer": "y"}]}
    (work / "transcribe.json").write_text(json.dumps(told))
    out = tmp_path / "out.json"
    assert main(["build", str(work), str(out)], spark) == 0
    made = [{"question": "Which?", "answer": "x"}, {"question": "Ticks", "answer": "y"}, {"question": "First question", "answer": "one answer"}, {"question": "Second", "answer": ["a", "b"]}]
    assert json.loads(out.read_text()) == made
    base = tmp_path / "base.json"
    base.write_text(json.dumps([{"question": "second", "answer": "old", "problem_id": "p"}, {"question": "Other", "answer": "kept"}]))
    assert main(["build", str(work), str(out), "--merge", str(base), "--skip-i", "3"], spark) == 0
    assert json.loads(out.read_text()) == [{"question": "second", "answer": "old", "problem_id": "p"}, {"question": "Other", "answer": "kept"}, made[2]]
    assert main(["build", str(work), str(out), "--merge", str(base), "--refresh"], spark) == 0
    assert json.loads(out.read_text()) == [made[3], {"question": "Other", "answer": "kept"}, *made[:3]]
