"""HWP files made here: a writer of compound files, records and paragraphs."""

import struct
import zlib

import pytest

from folioforge.sources import hwp


def record(tag, payload, level=0):
    size = len(payload)
    head = struct.pack("<I", tag | level << 10 | min(size, 0xFFF) << 20)
    return head + (struct.pack("<I", size) if size >= 0xFFF else b"") + payload


def para(text):
    return record(hwp.PARA_HEADER, b"\0" * 8) + record(hwp.PARA_TEXT, text if isinstance(text, bytes) else text.encode("utf-16-le"), 1)


def compound(streams, cutoff=4096, sector=512):
    """A compound file of streams by path ('a/b'), small ones in the mini stream."""
    entries = [["Root Entry", 5, 0, 0, hwp.FREE]]
    mini, mini_fat, sectors, fat = b"", [], [], []

    def put(raw):
        n = max(1, -(-len(raw) // sector))
        first = len(sectors)
        sectors.extend(raw[i * sector : (i + 1) * sector].ljust(sector, b"\0") for i in range(n))
        fat.extend([*range(first + 1, first + n), hwp.END])
        return first

    storages = {"": 0}
    children = {0: []}
    for path, raw in streams.items():
        parent = ""
        *folders, name = path.split("/")
        for folder in folders:
            own = f"{parent}/{folder}".lstrip("/")
            if own not in storages:
                storages[own] = len(entries)
                children[len(entries)] = []
                children[storages[parent]].append(len(entries))
                entries.append([folder, 1, 0, 0, hwp.FREE])
            parent = own
        if len(raw) < cutoff:
            first, n = len(mini_fat), max(1, -(-len(raw) // 64))
            mini += raw.ljust(n * 64, b"\0")
            mini_fat.extend([*range(first + 1, first + n), hwp.END])
        else:
            first = put(raw)
        children[storages[parent]].append(len(entries))
        entries.append([name, 2, first, len(raw), hwp.FREE])
    right = {}
    for parent, kids in children.items():
        entries[parent][4] = kids[0] if kids else hwp.FREE
        right.update(zip(kids, kids[1:], strict=False))
    entries[0][2], entries[0][3] = (put(mini), len(mini)) if mini else (hwp.END, 0)
    per = sector // 4
    first_mini = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) // per) * sector, b"\xff")) if mini_fat else hwp.END
    raw = b""
    for i, (name, kind, first, size, child) in enumerate(entries):
        coded = (name + "\0").encode("utf-16-le")
        raw += coded.ljust(64, b"\0") + struct.pack("<HBBIII", len(coded), kind, 1, hwp.FREE, right.get(i, hwp.FREE), child) + b"\0" * 36 + struct.pack("<IQ", first, size)
    first_dir = put(raw)
    n_fat = 1
    while n_fat * per < len(sectors) + n_fat:
        n_fat += 1
    places = [len(sectors) + k for k in range(n_fat)]
    fat += [0xFFFFFFFD] * n_fat
    fat += [hwp.FREE] * (n_fat * per - len(fat))
    table = struct.pack(f"<{len(fat)}I", *fat)
    sectors += [table[k * sector : (k + 1) * sector] for k in range(n_fat)]
    head = hwp.COMPOUND + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, n_fat, first_dir, 0, cutoff, first_mini, len(mini_fat), hwp.END, 0)
    return head + struct.pack("<109I", *places, *[hwp.FREE] * (109 - n_fat)) + b"".join(sectors)


def head(flags=0, signature=hwp.SIGNATURE):
    return signature.ljust(32, b"\0") + struct.pack("<II", 0x05010203, flags) + b"\0" * 216


def deflated(raw):
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return packer.compress(raw) + packer.flush()


def test_records():
    assert list(hwp.records(record(66, b"abc", 5) + record(67, b"x" * 6000) + record(1023, b"", 1023))) == [(66, 5, b"abc"), (67, 0, b"x" * 6000), (1023, 1023, b"")]
    assert list(hwp.records(record(66, b"abc") + record(67, b"abcdef")[:-1])) == [(66, 0, b"abc")]
    assert list(hwp.records(b"\1\2")) == [] == list(hwp.records(struct.pack("<I", 0xFFF << 20)))


def test_paragraph_text():
    control = lambda n: struct.pack("<H", n) + "garbage".encode("utf-16-le")
    text = "가나".encode("utf-16-le") + control(11) + "다".encode("utf-16-le") + control(9) + struct.pack("<HHHH", 24, 30, 13, 0) + "😀".encode("utf-16-le")
    assert hwp.paragraph_text(text) == ("가나다\t- \n😀", 2)
    assert hwp.paragraph_text(b"") == ("", 0) and hwp.paragraph_text(control(2)[:6]) == ("", 1) and hwp.paragraph_text(b"a\0b") == ("a", 0)
    for n in range(32):
        assert hwp.paragraph_text(control(n) + b"x\0")[0].endswith("x")


@pytest.mark.parametrize("size", [10, 100, 70_000])
def test_compound(size):
    streams = {"FileHeader": b"a" * size, "BodyText/Section0": b"b" * (size + 5000), "BodyText/Section1": b"c" * size, "deep/er/x": b"d"}
    file = hwp.Compound(compound(streams))
    assert set(file.places) == {k.lower() for k in streams}
    for path, raw in streams.items():
        assert file.find(path.lower()) == raw
    assert file.find("section0") == streams["BodyText/Section0"] and file.find("none") is None
    for bad in (b"", b"x" * 600, compound(streams)[:700]):
        with pytest.raises((ValueError, struct.error)):
            hwp.Compound(bad).find("fileheader")


def test_files(spark):
    body = para("제1조 목적") + para("본문은 여기에 있다. " * 9) + record(hwp.TABLE, b"") + para("  ") + record(hwp.PARA_TEXT, "끝".encode("utf-16-le"))
    second = para("둘째 구역의 글")
    short = {"FileHeader": head(), "BodyText/Section0": para("짧다")}
    files = {
        "plain": {"FileHeader": head(), "BodyText/Section0": body, "BodyText/Section1": second},
        "packed": {"FileHeader": head(1), "BodyText/Section0": deflated(body), "BodyText/Section1": second},
        "locked": {"FileHeader": head(2)}, "handed out": {"FileHeader": head(4)}, "doc": {"WordDocument": b"x"}, "other": {"Workbook": b"x"}, "signature": {"FileHeader": head(0, b"Another file")},
        "preview": short | {"PrvText": "미리 보는 글이 여기 있다\r\n\r\n둘째\x01 줄\0\0".encode("utf-16-le") + b"x"}, "short": short, "empty": {"FileHeader": head(), "BodyText/Section0": b""},
    }
    rows = [(name, compound(streams)) for name, streams in files.items()] + [("broken", compound(files["plain"])[:900]), ("null", None)]
    docs, blocks = hwp.read_hwp(spark.createDataFrame(rows, "path string, content binary"))
    got = {r["path"]: r for r in docs.collect()}
    assert {k: r["error"] for k, r in got.items() if r["error"]} == {"locked": "ENCRYPTED", "handed out": "HWP_DISTRIBUTION_DOC", "doc": "LEGACY_DOC", "other": "NOT_HWP", "signature": "NOT_HWP", "empty": "CORRUPTED", "broken": "CORRUPTED"}
    assert {k: (r["confidence"], r["warnings"]) for k, r in got.items() if not r["error"]} == {k: (0.85, "TABLE_FLATTENED,HWP_NO_PAGE_INFO") for k in ("plain", "packed")} | {"preview": (0.4, "PARTIAL_PARSE,HWP_NO_PAGE_INFO"), "short": (0.85, "HWP_NO_PAGE_INFO")}
    assert got["plain"]["version"] == "5.1.2.3" and got["plain"]["sections"] == 2
    texts = lambda name: [(r["section"], r["text"]) for r in blocks.where(f"path = '{name}'").orderBy("block_ix").collect()]
    assert texts("plain") == texts("packed") == [(0, "제1조 목적"), (0, "본문은 여기에 있다. " * 8 + "본문은 여기에 있다."), (0, "끝"), (1, "둘째 구역의 글")]
    assert texts("preview") == [(None, "미리 보는 글이 여기 있다"), (None, "둘째 줄")] and texts("short") == [(0, "짧다")]
