"""Zip archives as they come: whole ones, damaged ones, and those that must not be unpacked."""

import hashlib
import json
import zipfile

import pytest

from strandline.sources import archives
from strandline.sources.archives import Limits


def put(path, *members, method=zipfile.ZIP_DEFLATED, **kinds):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members:
            info = zipfile.ZipInfo(name)
            info.compress_type = method
            if name in kinds.get("links", ()):
                info.external_attr = 0o120777 << 16
            z.writestr(info, data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("zips")
    rows = [json.dumps({"k": k, "t": "é" * k}) for k in range(50)]
    put(d / "good.zip", ("a.jsonl", "\n".join(rows) + "\n"), ("sub/b.jsonl", "\n\n{}\n  \nlast"), ("c.txt", "x"), ("empty.jsonl", ""))
    put(d / "up.zip", ("../a.jsonl", "{}"))
    put(d / "abs.zip", ("/a.jsonl", "{}"))
    put(d / "twice.zip", ("A.jsonl", "{}"), ("a.jsonl", "{}"))
    put(d / "link.zip", ("l.jsonl", "/etc/hosts"), links=("l.jsonl",))
    put(d / "bomb.zip", ("z.jsonl", "0" * 3_000_000))
    put(d / "large.zip", *((f"{k}.jsonl", hashlib.sha256(str(k).encode()).hexdigest() * 400) for k in range(8)), method=zipfile.ZIP_STORED)
    (d / "none.zip").write_bytes(b"PK but no archive")
    put(d / "torn.zip", ("t.jsonl", "\n".join(f"line {k} {hashlib.md5(str(k).encode()).hexdigest()}" for k in range(3000))), method=zipfile.ZIP_STORED)
    data = bytearray((d / "torn.zip").read_bytes())
    data[60_000:60_004] = b"\xff\xff\xff\xff"
    (d / "torn.zip").write_bytes(bytes(data))
    put(d / "locked.zip", ("s.jsonl", "{}"))
    data = bytearray((d / "locked.zip").read_bytes())
    data[6] |= 1
    data[data.rindex(b"PK\x01\x02") + 8] |= 1
    (d / "locked.zip").write_bytes(bytes(data))
    return f"file://{d}"


def test_unsafe_archives_are_refused_before_they_are_read(spark, folder):
    limits = Limits(members=6, member_bytes=4_000_000, total_bytes=160_000, ratio=100)
    got = {}
    for r in archives.checked(spark, folder, limits).collect():
        name = r["archive"].split("/")[-1]
        got.setdefault(name, [r["refused"], set()])[1].add(r["problem"])
    assert {k: v[0] for k, v in got.items()} == {k: k not in ("good.zip", "torn.zip") for k in got} and len(got) == 10
    assert {k: v[1] - {None} for k, v in got.items() if v[0]} == {
        "up.zip": {"path"}, "abs.zip": {"path"}, "twice.zip": {"duplicate"}, "link.zip": {"link"}, "bomb.zip": {"ratio"}, "large.zip": {"total"}, "none.zip": {"no archive"}, "locked.zip": {"encrypted"},
    }


def test_lines_of_members(spark, folder):
    limits = Limits(total_bytes=1_000_000, ratio=100)
    got = {}
    for r in archives.lines(spark, folder, limits).collect():
        got.setdefault((r["archive"].split("/")[-1], r["member"]), []).append((r["line"], r["text"], r["problem"]))
    assert {k for k in got if k[0] != "large.zip"} == {("good.zip", "a.jsonl"), ("good.zip", "sub/b.jsonl"), ("torn.zip", "t.jsonl")}
    assert sorted(got["good.zip", "a.jsonl"]) == [(k, json.dumps({"k": k, "t": "é" * k}), None) for k in range(50)]
    assert sorted(got["good.zip", "sub/b.jsonl"]) == [(2, "{}", None), (4, "last", None)]
    assert [p for _, t, p in got["torn.zip", "t.jsonl"] if t is None] and len(got["large.zip", "0.jsonl"]) == 1


def test_packs(spark, tmp_path):
    files = {"data/a.jsonl": b'{"x": 1}\n', "data/b.jsonl": b'{"x": 2}\n'}
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def pack(name, version=1, change=lambda members, sums: None):
        manifest = json.dumps({"schema_version": version, "files": [{"path": p, "size_bytes": len(b), "sha256": sha(b)} for p, b in files.items()]}, indent=1).encode()
        members, sums = {"manifest.json": manifest, **files}, {p: sha(b) for p, b in {"manifest.json": manifest, **files}.items()}
        change(members, sums)
        put(tmp_path / f"{name}.zip", *members.items(), *([("checksums.txt", "".join(f"{s}  {p}\n" for p, s in sums.items()))] if sums is not None and name != "nosums" else []))

    pack("whole")
    pack("newer", 2)
    pack("nosums")
    pack("changed", change=lambda m, s: m.update({"data/a.jsonl": b'{"x": 9}\n'}))
    pack("longer", change=lambda m, s: (m.update({"data/a.jsonl": b'{"x": 1}\n\n'}), s.update({"data/a.jsonl": sha(b'{"x": 1}\n\n')})))
    pack("more", change=lambda m, s: (m.update({"data/c.jsonl": b"x"}), s.update({"data/c.jsonl": sha(b"x")})))
    pack("less", change=lambda m, s: m.pop("data/b.jsonl"))
    pack("unsummed", change=lambda m, s: s.pop("data/b.jsonl"))
    got = sorted((r["archive"].split("/")[-1][:-4], r["member"], r["problem"]) for r in archives.pack_problems(spark, f"file://{tmp_path}").collect())
    assert got == sorted([
        ("newer", "manifest.json", "newer layout"), ("nosums", None, "lacks checksums.txt"), ("changed", "data/a.jsonl", "other checksum"), ("longer", "data/a.jsonl", "other size"), ("more", "data/c.jsonl", "not in the manifest"),
        ("less", "data/b.jsonl", "not there"), ("unsummed", "data/b.jsonl", "not in the checksums"),
    ], key=lambda r: (r[0], str(r[1]), r[2]))
