"""Benchmark leaks and archives: planted cases, exact round trips, odd input."""

import base64
import hashlib
import random

import pytest
from llmcases import ODD, make_docs, words  # noqa: F401

from loomwork.llm import decontaminate, warc

ITEMS = [
    (1, "A farmer named Alice sells 12 kg of apples and then Alice buys 30 more boxes from her neighbour Bob for 45 dollars in the old market."),
    (2, "Short question about rivers."),
    (3, words(40, 77)),
    (4, None),
    (5, "it"),
]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def leaky():
    pad = lambda k, t: f"{words(30, k)}. {t} {words(30, k + 1000)}"
    return [
        (10, pad(1, ITEMS[0][1])),
        (11, pad(2, ITEMS[0][1].replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "7").replace("30", "1,250.5").replace("45", "9"))),
        (12, pad(3, ITEMS[0][1].replace("Alice", "Carol", 1))),  # one name stands for two
        (13, pad(4, ITEMS[1][1])),
        (14, pad(5, " ".join(ITEMS[2][1].split()[5:25]))),
        (15, pad(6, " ".join(ITEMS[2][1].split()[5:15]))),  # ten words are too few
        (16, words(200, 9)),
        (17, ITEMS[0][1].upper()),
        (18, pad(8, ITEMS[0][1].replace("kg", "miles"))),
    ]


WANT = {(10, 1), (11, 1), (13, 2), (14, 3), (18, 1)}


@pytest.mark.parametrize("limit", [decontaminate.PROBE_CHARACTERS, 0], ids=["probed", "joined"])
def test_leaks(spark, make_docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "PROBE_CHARACTERS", limit)
    docs = make_docs([*leaky(), *ODD, (10, leaky()[0][1])])
    got = decontaminate.leaks(docs, bench(spark)).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    assert len(pairs) == len(set(pairs)) and {p for p in pairs if p[0] not in (12, 17)} == WANT
    by = {(r.doc_id, r.item_id): r for r in got}
    assert by[10, 1].n_changed == 0 and (by[11, 1].n_changed, by[11, 1].n_slots) == (6, 8)  # two units stay
    # The part of 12 in which names are consistent is a match of its own only if it is long enough.
    assert all(r.n_matched >= 13 or r.item_id == 2 for r in got)
    # leaks names ids; clean judges each row by its own text, so other texts under a leaking id stay.
    clean = [(r.doc_id, r.text) for r in decontaminate.clean(docs, bench(spark)).collect()]
    assert sorted(clean, key=str) == sorted([r for r in leaky() if r[0] not in {p[0] for p in pairs}] + ODD, key=str)


@pytest.mark.parametrize("limit", [decontaminate.PROBE_CHARACTERS, 0], ids=["probed", "joined"])
def test_leaks_in_other_letter_case(spark, make_docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "PROBE_CHARACTERS", limit)
    text = ITEMS[0][1]
    changed = text.replace("12", "7").replace("45", "9")
    docs = make_docs([leaky()[7], (21, text.lower()), (22, text.title()), (23, changed.upper()), (24, changed.replace("Alice", "Carol").title()), (25, " ".join(words(30, 5).split()).upper())])
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_slots, r.n_changed) for r in decontaminate.leaks(docs, bench(spark, [*ITEMS, (6, ITEMS[0][1].upper())])).collect()}
    assert {k: v for k, v in got.items() if k[1] == 1} == {(17, 1): (27, 8, 0), (21, 1): (27, 8, 0), (22, 1): (27, 8, 0), (23, 1): (27, 8, 2), (24, 1): (27, 8, 4)}
    assert {17, 21, 22, 23} <= {d for d, i in got if i == 6}
    assert {r.doc_id for r in decontaminate.clean(docs, bench(spark)).collect()} == {25}


@pytest.mark.parametrize("limit", [decontaminate.PROBE_CHARACTERS, 0], ids=["probed", "joined"])
def test_leaks_with_contradicting_slots(spark, make_docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "PROBE_CHARACTERS", limit)
    text = ITEMS[0][1]
    long = f"{words(30, 50)} then 5 of {words(30, 51)} and 5 of {words(6, 52)}"
    short = "Take 5 of them or 5 of us"
    docs = make_docs([
        leaky()[2],  # the 23 tokens behind the first Alice are consistent
        (31, text.replace("12", "4").replace("30", "4").replace("45", "4")),  # different values become one
        (32, long.replace("then 5", "then 6")),  # 64 tokens before the second 5, 40 behind the first
        (33, short.replace("or 5", "or 6")),  # parts are shorter than the item
        (34, text.replace("Alice sells", "Carol sells").replace("more boxes from her neighbour", "more bags of their friend")),
    ])
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_slots, r.n_changed) for r in decontaminate.leaks(docs, bench(spark, [*ITEMS, (6, long), (7, short)])).collect()}
    assert got == {(12, 1): (23, 7, 0), (31, 1): (27, 8, 3), (32, 6): (64, 1, 1)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench(spark, [*ITEMS, (6, long), (7, short)])).collect()} == {33, 34}


@pytest.mark.parametrize("limit", [decontaminate.PROBE_CHARACTERS, 0], ids=["probed", "joined"])
def test_leaks_of_little_else_than_slots(spark, make_docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "PROBE_CHARACTERS", limit)
    items = [(1, "What is 12 + 45?"), (2, "3 km 5 m 7 cm"), (3, "Sort 17, 4, 99, 23, 8, 61, 12, 5, 70, 31, 2, 48, 55, 16 now"), (4, "the guests Anna Bert Carl Dora Emil Fred Gina Hans Ines Jörg Karl Lena Mark")]
    pad = lambda t: f"{words(20, 60)}. {t} {words(20, 61)}"
    docs = make_docs([*((k, pad(t)) for k, t in items), (11, pad("WHAT IS 12 + 45?")), (12, pad("What is 13 + 45?")), (13, pad(items[2][1].replace("12", "13"))), (14, pad("THE GUESTS" + items[3][1][10:].upper())), (15, pad("17, 4, 99, 23, 8, 61, 12, 5, 70"))])
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_slots, r.n_changed) for r in decontaminate.leaks(docs, bench(spark, items)).collect()}
    assert got == {(1, 1): (4, 2, 0), (11, 1): (4, 2, 0), (2, 2): (6, 6, 0), (3, 3): (16, 14, 0), (4, 4): (15, 13, 0), (14, 4): (15, 13, 0)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench(spark, items)).collect()} == {12, 13, 15}


def test_nothing_to_find(spark, make_docs):
    assert decontaminate.leaks(make_docs([]), bench(spark)).collect() == []
    assert decontaminate.leaks(make_docs(leaky()), bench(spark, [])).collect() == []
    assert decontaminate.clean(make_docs(leaky()), bench(spark, [])).count() == len(leaky())


def test_templates():
    import pyarrow as pa

    from loomwork.llm import kernel

    data, offs = kernel.text_buffers(pa.array(["We met Élan at 3,000.5 km. Then nine", None, "", "5 g"]))
    kind, _, first = decontaminate.templates(data, offs)
    assert kind.tolist() == [0, 0, 2, 0, 1, 3, 0, 0, 1, 3] and first.tolist() == [0, 8, 8, 8, 10]


def test_arc_versions_and_lengths():
    records = [({"URL": "http://a/x y", "IP-address": "1.2.3.4", "Archive-date": "19970412", "Content-type": "text/html"}, b"HTTP/1.0 200 OK\r\n\r\n<p>\n\nfiledesc://x 1 2 3 4\n"), ({"URL": "http://b", "IP-address": "-", "Archive-date": "20010203040506", "Content-type": "text/plain"}, b"")]
    for version in "12":
        got = list(warc.read_arc(warc.write_arc(records, version)))
        assert [r.content for r in got] == [c for _, c in records] and {r.version for r in got} == {version}
        out = b"".join(warc.convert(r) + warc.END.encode() for r in got)
        (f, block), (g, empty) = warc.read_warc(out)
        assert f["warc-type"] == "response" and f["warc-date"] == "1997-04-12T00:00:00Z" and f["warc-ip-address"] == "1.2.3.4" and f["warc-target-uri"] == "http://a/x%20y"
        assert block == records[0][1] and f["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert g["warc-type"] == "resource" and g["content-type"] == "text/plain" and g["warc-date"] == "2001-02-03T04:05:06Z" and empty == b""
    for bad in (b"", b"http://x 1 2 3 5\nhello", warc.write_arc(records)[:-30], b"filedesc://x 0.0.0.0 1 text/plain 9\n9 0 me\nA\n"):
        with pytest.raises(warc.ArcError):
            list(warc.read_arc(bad))


def test_archives(spark, tmp_path):
    rng = random.Random(3)
    big = "".join(rng.choices("abcdé \r\n", k=1500))
    rows = [(i, f"http://x/{i % 7}", t) for i, t in enumerate([big, "small", None, "", big, "small", "HTTP/1.1 fake\r\n\r\n" + "é" * 800, big + "!", "HTTP/1.1 fake\r\n\r\n" + "é" * 800, big, "WARC/1.0\r\nX: y\r\n\r\n" * 80])] + [(None, None, "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = sorted(warc.read_archives(spark, str(tmp_path / "w")).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [r.page_id for r in got] == [r[0] for r in rows] and all(r.digest_ok for r in got)
    for r, (_, _, html) in zip(got, rows, strict=True):
        payload = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {0: 9, 4: 9, 6: 8}
    assert len({r.record_id for r in got}) >= 8
    empty = pages.where("false")
    warc.write_archives(empty, str(tmp_path / "e"))


def test_archives_of_repeated_page_ids(spark, tmp_path):
    a, b, c = ("abc"[k] * 1500 for k in range(3))
    rows = [(1, "http://x/1", a), (1, "http://x/2", b), (1, "http://x/3", c), (1, "http://x/1", a), (8, "http://x/8", a), (9, "http://x/9", b), (9, "http://x/8", b), (None, "http://x/n", a)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"))
    sha1 = lambda t: hashlib.sha1(t.encode()).hexdigest()
    got = [(r.page_id, r.url, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()]
    refers = {(1, a): 8, (1, b): 9}
    want = [(i, u, sha1(t), "revisit" if (i, t) in refers else "response", refers.get((i, t))) for i, u, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_identifiers_of_records(spark, tmp_path):
    import gzip

    big = "x" * 1500
    rows = [(1, "http://x/1", big), (2, "http://x/1", big), (3, "http://x/1", big), (4, "http://x/4", "small"), (5, "http://x/4", "small"), (6, "http://x/6 y", None), (7, "http://x/6 y", None)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    got = {f["warc-page-id"]: f for p in (tmp_path / "w").glob("*.gz") for f, _ in warc.read_warc(gzip.decompress(p.read_bytes()))}
    assert sorted(got) == list("1234567") and len({f["warc-record-id"] for f in got.values()}) == 7
    assert {k: f["warc-refers-to"] for k, f in got.items() if f["warc-type"] == "revisit"} == dict.fromkeys("12", got["3"]["warc-record-id"])
