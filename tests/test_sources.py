import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkweir.sources import documents, files


def test_pages_of_a_file_and_a_changed_file(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("external_id,title,initial_price,extra\n1,A,\"1 000,5\",x\n2,B,,y\n3,C,7,z\n")
    columns = ["external_id", "title", "initial_price", "extra"]
    first, cursor = files.page(spark, str(path), "csv", columns, "external_id", None, 2)
    assert [r.external_id for r in first.collect()] == ["1", "2"] and cursor[1] == 2
    rest, end = files.page(spark, str(path), "csv", columns, "external_id", cursor, 2)
    assert [r.external_id for r in rest.collect()] == ["3"] and end is None
    found = files.records(first, "File").collect()
    assert str(found[0].initial_price) == "1000.50" and found[0].currency == "RUB" and json.loads(found[0].raw) == {"extra": "x"}
    path.write_text("external_id,title,initial_price,extra\n9,Z,1,x\n")
    with pytest.raises(files.Refused):
        files.page(spark, str(path), "csv", columns, "external_id", cursor, 2)


def test_json_kinds_and_guard(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"external_id":"1","title":"A"}\n\n{"external_id":"2","title":"B"}\n')
    assert files.rows(spark, str(tmp_path / "a.jsonl"), "jsonl", ["external_id", "title"]).count() == 2
    (tmp_path / "b.json").write_text('{"schema_version":"1","records":[{"external_id":"1","title":"A"}]}')
    assert files.rows(spark, str(tmp_path / "b.json"), "json", ["external_id", "title"]).first().title == "A"
    assert files.guarded(spark, str(tmp_path / "b.json"), str(tmp_path)).count() == 1
    with pytest.raises(files.Refused):
        files.guarded(spark, str(tmp_path / "x/../../b.json"), str(tmp_path))
    with pytest.raises(files.Refused):
        files.guarded(spark, str(tmp_path / "b.json"), str(tmp_path), most=3)


def test_snapshots_bundles_and_publishing(spark, tmp_path):
    tender = {"id": "1", "title": "T", "documents": [{"id": "d", "title": "x", "text": "abc"}]}
    snap = json.dumps({"schema_version": "1", "tenders": [tender]}).encode()
    manifest = json.dumps({"snapshot_sha256": hashlib.sha256(snap).hexdigest()}).encode()
    commit = json.dumps({"snapshot_sha256": hashlib.sha256(snap).hexdigest(), "manifest_sha256": hashlib.sha256(manifest).hexdigest()}).encode()
    for name, data in (("snapshot", snap), ("manifest", manifest), ("commit", commit)):
        (tmp_path / f"{name}.json").write_bytes(data)
    assert files.bundle(spark, str(tmp_path)).count() == 1
    (tmp_path / "snapshot.json").write_bytes(json.dumps({"schema_version": "1", "tenders": [tender, tender]}).encode())
    with pytest.raises(files.Refused):
        files.bundle(spark, str(tmp_path))
    with pytest.raises(files.Refused):
        files.snapshot(spark, str(tmp_path / "snapshot.json"))
    files.publish(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(files.Refused):
        files.publish(spark.range(4), str(tmp_path / "out"))


def test_research_rows_sinks_and_plans(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rows": [{"card": {"id": "1", "title": "T"}}, {"gaps": []}]}))
    assert files.research_rows(spark, str(tmp_path / "r.json")).count() == 1
    files.write_separated(spark.range(2), str(tmp_path / "tsv"))
    assert files.rows(spark, str(tmp_path / "tsv"), "tsv", ["id"]).count() == 2
    assert "| id |" in files.write_report([("Ids", spark.range(2))], str(tmp_path / "report.md"))
    assert files.migration_plan([("2", "b"), ("1", "a")], {"1": hashlib.sha256(b"a").hexdigest()}) == ["2"]
    with pytest.raises(files.Refused):
        files.migration_plan([("1", "changed")], {"1": hashlib.sha256(b"a").hexdigest()})
    assert files.profile("a: [1, 2]")["profile"] == {"a": [1, 2]}
    for bad in ("a: 1\na: 2", "api_key: x", "a: " + "[" * 20 + "]" * 20):
        with pytest.raises(files.Refused):
            files.profile(bad)
    assert files.rules_table(spark, {"a": ["x", "y"]}).count() == 2
    assert files.budgeted(iter([("a", 5), ("b", 9), ("c", 4)]), 5, 10) == ["a", "c"]
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),)], "c binary")
    assert [r[0] for r in df.select(files.decoded(F.col("c"))).collect()] == ["é", "é"]


def test_packages(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><row><c t="inlineStr"><is><t>name</t></is></c><c><f>1+1</f><v>2</v></c></row></worksheet>')
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("../evil.txt", "no")
        z.writestr("b.xlsx", inner.getvalue())
        z.writestr("c.bin", "??")
    df = spark.createDataFrame([("p.zip", bytearray(outer.getvalue())), ("x.html", bytearray(b"<p>one<td>two<script>no</script>")), ("e.txt", bytearray(b"")), ("bad.zip", bytearray(b"PK\x03\x04zzz"))], "name string, content binary")
    found = {r.title: (r.status, r.text, r.gap) for r in documents.texts(df).collect()}
    assert found["p.zip/a.txt"] == ("extracted", "hello", None)
    assert found["p.zip/b.xlsx"] == ("extracted", "name\t2", "1_formulas")
    assert found["p.zip/../evil.txt"][0] == "invalid" and found["p.zip/c.bin"][0] == "unsupported"
    assert found["x.html"] == ("extracted", "one | two", None) and found["e.txt"][0] == "empty" and found["bad.zip"][0] == "invalid"
    status = {r.name: r.package for r in documents.package_status(documents.texts(df)).collect()}
    assert status == {"p.zip": "partial", "x.html": "complete", "e.txt": "none", "bad.zip": "none"}


def zipped(members):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def letter(*lines):
    return f"<w:document {W}>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:document>"


def test_html_text():
    page = """<html><head><title>no</title></head><body><header>Top</header><p>a &amp; b<br>c</p><script>if (a < b) x()</script><svg><text>no</text></svg>
    <!-- <p>no</p> --><table><tr><td>1</td><td title="x > y">2</td></tr></table><a href="/p?a=1&amp;b=2">one</a> <a class='k' href=two>two</a>
    <a href="#top">t</a><a href='mailto:x@y'>m</a><a href="JavaScript:go()">j</a><a href="tel:1">p</a><style>no"""
    text, links = documents.html_text(page)
    assert text == "Top\na & b\nc\n| 1 | 2\none two\ntmjp" and links == ["/p?a=1&b=2", "two"]
    assert documents.html_text(None) == ("", []) and documents.html_text("a < b and 3 > 2") == ("a < b and 3 > 2", [])


def test_texts_are_whole_or_refused(monkeypatch):
    one = lambda data, name: [(r["status"], r["text"], r["gap"]) for r in documents.extract(data, name)]
    parts = {"word/document.xml": letter("body", "more"), "word/header1.xml": letter("head"), "word/footnotes.xml": letter("note")}
    assert one(zipped(parts), "a.docx") == [("extracted", "body\nmore\nnote\nhead", None)]
    assert one(zipped({"word/document.xml": letter("x" * 300_000)}), "a.docx") == [("invalid", None, "ratio")]
    rnd = "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(210_000))
    assert one(zipped({"word/document.xml": letter(rnd)}), "a.docx") == [("too_large", None, "characters")] == one(rnd.encode(), "a.txt")
    rows = lambda n: f"<worksheet {S}>" + "".join(f"<row><c><v>{i * 7919}</v></c></row>" for i in range(n)) + "</worksheet>"
    assert one(zipped({"xl/worksheets/sheet1.xml": rows(3)}), "a.xlsx") == [("extracted", "0\n7919\n15838", None)]
    assert one(zipped({"xl/worksheets/sheet1.xml": rows(2001)}), "a.xlsx") == [("too_large", None, "rows")]
    assert one(zipped({f"xl/worksheets/sheet{i}.xml": rows(1) for i in range(11)}), "a.xlsx") == [("too_large", None, "sheets")]
    assert one(b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>', "a.xml") == [("invalid", None, "document_type")]
    good = bytearray(zipped({"a.txt": "some words that are long enough to be deflated, again and again and again"}))
    good[40:60] = b"\xff" * 20
    assert one(bytes(good), "a.zip")[0][0] == "invalid"
    monkeypatch.setattr(documents, "UNPACKED", 1000)
    found = one(zipped({"a.txt": "a" * 10, "b.txt": "".join(chr(33 + i * 7 % 90) for i in range(995)), "c.txt": "c"}), "a.zip")
    assert [x[0] for x in found] == ["extracted", "too_large", "extracted"]
