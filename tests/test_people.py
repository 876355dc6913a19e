from homestream.operators import people
from homestream.schemas import GALLERY
from homestream.sources.people import (
    EncodingStore, clear_gallery, load_gallery, remove_people, retrain, save_gallery, scan_images,
)


def encode(content):
    if content == b"bad":
        raise ValueError("unreadable")
    if content == b"none":
        return []
    return [[float(b), 1.0] for b in content]


def test_rebuild(spark, tmp_path):
    for name, files in {"ann": {"1.jpg": b"\1\2", "2.JPEG": b"bad"}, "bob": {"x.png": b"\3", "notes.txt": b"\4", "y.bmp": b"none"}}.items():
        (tmp_path / "dataset" / name).mkdir(parents=True)
        for f, content in files.items():
            (tmp_path / "dataset" / name / f).write_bytes(content)
    images = scan_images(spark, str(tmp_path / "dataset"))
    assert sorted(r.name for r in people.list_people(images).collect()) == ["ann", "bob"]
    encoded = people.encode_images(images, encode)
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in encoded.filter("error is not null").collect()}
    assert errors == {"2.JPEG": "ValueError: unreadable", "y.bmp": "no face"}
    gallery = people.rebuild_gallery(encoded)
    rows = sorted(gallery.collect(), key=lambda r: r.gallery_idx)
    assert [(r.name, r.encoding[0]) for r in rows] == [("ann", 1.0), ("ann", 2.0), ("bob", 3.0)]

    store = str(tmp_path / "gallery")
    assert load_gallery(spark, store).count() == 0
    save_gallery(gallery, store)
    assert load_gallery(spark, store).schema == GALLERY
    assert {r.name: r.faces for r in people.gallery_stats(load_gallery(spark, store)).collect()} == {"ann": 2, "bob": 1}
    save_gallery(people.remove_person(load_gallery(spark, store), ["ann"]), store)
    assert [r.name for r in load_gallery(spark, store).collect()] == ["bob"]
    gone = spark.createDataFrame([("bob",)], "name string")
    assert people.remove_person(load_gallery(spark, store), gone).count() == 0
    clear_gallery(spark, store)
    assert load_gallery(spark, store).count() == 0


def test_uploads(spark):
    rows = [("a", "image/png")] * 5 + [("b", "image/png")] * 4 + [("c", "image/png")] * 4 + [("c", None)]
    df = spark.createDataFrame(rows, "name string, content_type string")
    got = {r.name: (r.files, r.all_images, r.valid) for r in people.validate_uploads(df).collect()}
    assert got == {"a": (5, True, True), "b": (4, True, False), "c": (5, False, False)}


def test_retrain_encodes_unseen_images_only(spark, tmp_path):
    rows = [("d/ann/1.jpg", b"\1\2"), ("d/ann/2.jpg", b"bad"), ("d/bob/1.jpg", b"\3"), ("d/bob/copy.jpg", b"\1\2"), ("d/eve/1.jpg", b"none")]
    images = spark.createDataFrame(rows, "path string, content binary")
    store, path, seen = EncodingStore(spark, str(tmp_path / "store")), str(tmp_path / "gallery"), str(tmp_path / "seen")

    def model(content):
        with open(seen, "ab") as f:
            f.write(bytes(content) + b"|")
        return encode(content)

    def gallery(df):
        return [(r.gallery_idx, r.name, r.encoding[0]) for r in df.orderBy("gallery_idx").collect()]

    def calls():
        with open(seen, "rb") as f:
            return sorted(f.read().split(b"|")[:-1])

    want = [(0, "ann", 1.0), (1, "ann", 2.0), (2, "bob", 3.0), (3, "bob", 1.0), (4, "bob", 2.0)]
    assert gallery(retrain(images, model, store, path)) == want
    assert calls() == [b"\1\2", b"\3", b"bad", b"none"]          # a copy is one content
    assert gallery(retrain(images, model, store, path)) == want and len(calls()) == 4
    more = images.unionByName(spark.createDataFrame([("d/ann/3.jpg", b"\7")], "path string, content binary"))
    assert len(gallery(retrain(more, model, store, path))) == 6 and len(calls()) == 5

    left = remove_people(more, ["ann"], model, store, path)
    assert gallery(left) == [(0, "bob", 3.0), (1, "bob", 1.0), (2, "bob", 2.0)] and len(calls()) == 5
    # what only the removed person had is forgotten, what others have too isn't
    assert sorted(r.encoding[0] for r in store.read().filter("error is null").collect()) == [1.0, 2.0, 3.0]
    assert gallery(remove_people(more, ["ann", "bob", "eve"], model, store, path)) == [] and store.read().count() == 0
    assert load_gallery(spark, path).schema == GALLERY
