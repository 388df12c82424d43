"""The store by content: borders that follow the content, shared chunks, restored files, interrupted commits."""

import hashlib
import io
import os

import numpy as np
import pytest

from quarry.sources import chunks as C

SIZES = (256, 1024, 4096)


def data(seed, n):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


def blobs(store):
    return {f for f in os.listdir(f"{store}/blobs") if not f.startswith(".")}


def test_the_rolling_hash_is_that_of_the_last_bytes():
    x = np.frombuffer(data(1, 500), dtype=np.uint8)
    h = C.rolling(x)
    for i in (0, 5, 63, 64, 200, 499):
        want = sum(int(C._GEAR[x[i - d]]) << d for d in range(min(64, i + 1))) % (1 << 64)
        assert int(h[i]) == want


def test_chunks_do_not_depend_on_reads_and_follow_the_content(monkeypatch):
    text = data(2, 60_000)
    whole = list(C.cuts(io.BytesIO(text), *SIZES))
    assert b"".join(whole) == text and len(whole) > 20 and all(256 <= len(c) <= 4096 for c in whole[:-1])
    for piece in (100, 1000, 7777):
        monkeypatch.setattr(C, "PIECE", piece)
        assert list(C.cuts(io.BytesIO(text), *SIZES)) == whole
    edited = text[:30_000] + b"an insertion" + text[30_000:]
    fresh = set(C.cuts(io.BytesIO(edited), *SIZES)) - set(whole)
    assert 1 <= len(fresh) <= 4
    assert list(C.cuts(io.BytesIO(b""), *SIZES)) == [] and list(C.cuts(io.BytesIO(b"\0" * 9000), *SIZES))[0] == b"\0" * 4096


def test_commit_edit_and_checkout(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "FAN", 4)
    source, store = tmp_path / "in", str(tmp_path / "store")
    (source / "sub/deep").mkdir(parents=True)
    files = {"a.bin": data(3, 50_000), "sub/b.bin": data(4, 20_000), "sub/deep/c": data(3, 50_000), "empty": b"", "é x.txt": b"text"}
    for name, content in files.items():
        (source / name).write_bytes(content)
    first = C.commit(spark, "d", str(source), store, {"k": 1}, sizes=SIZES)
    assert first == C.commit(spark, "d", str(source), store, {"k": 1}, sizes=SIZES) != C.commit(spark, "d", str(source), store, {"k": 2}, sizes=SIZES)
    before = blobs(store)
    assert {hashlib.sha256(open(f"{store}/blobs/{b}", "rb").read()).hexdigest() for b in before} == before
    (source / "a.bin").write_bytes(files["a.bin"][:25_000] + b"!" + files["a.bin"][25_000:])
    (source / "empty").unlink()
    (source / "new").write_bytes(b"n")
    second = C.commit(spark, "d", str(source), store, {"k": 1}, parent=first, sizes=SIZES)
    assert 2 <= len(blobs(store) - before) <= 5  # the edited chunks and the new file
    assert sorted(map(tuple, C.changes(spark, "d", first, second, store).collect())) == [("a.bin", "changed"), ("empty", "removed"), ("new", "added")]
    assert C.checkout(spark, "d", first, store, f"{tmp_path}/out") == 5
    assert {n: (tmp_path / "out" / n).read_bytes() for n in files} == files
    assert C.checkout(spark, "d", second, store, f"{tmp_path}/out2") == 5 and (tmp_path / "out2/a.bin").read_bytes()[25_000:25_001] == b"!"
    victim = sorted(before)[0]
    os.chmod(f"{store}/blobs/{victim}", 0o644)
    open(f"{store}/blobs/{victim}", "wb").write(b"damaged")
    with pytest.raises(Exception, match="damaged"):
        C.checkout(spark, "d", first, store, f"{tmp_path}/out3")


def test_an_interrupted_commit_is_harmless(spark, tmp_path, monkeypatch):
    """Chunks of a commit that broke off are used by the next; no version names what is missing, and half a chunk has no name."""
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    (source / "a").write_bytes(data(5, 30_000))
    monkeypatch.setattr(C, "roots", lambda chunks: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        C.commit(spark, "d", str(source), store, sizes=SIZES)
    assert blobs(store) and not os.path.exists(f"{store}/versions")
    before = blobs(store)
    monkeypatch.undo()
    version = C.commit(spark, "d", str(source), store, sizes=SIZES)
    assert blobs(store) == before and os.listdir(f"{store}/partial") == []
    assert C.checkout(spark, "d", version, store, f"{tmp_path}/out") == 1 and (tmp_path / "out/a").read_bytes() == data(5, 30_000)
    (tmp_path / "none").mkdir()
    nothing = C.commit(spark, "d", str(tmp_path / "none"), store)
    assert C.checkout(spark, "d", nothing, store, f"{tmp_path}/out4") == 0
