import pytest
import hashlib
import math

from pyspark.sql import functions as F

from tidewall.operators import files as T
from tidewall.operators import threats as H


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "id int, html string")


def found(spark, html):
    return [(r.element, r.attribute, r.threat) for r in H.scan_markup(pages(spark, html), "id", "html").collect()]


def test_markup_threats(spark):
    assert found(spark, '<svg onload="x()"><foreignObject><b onclick="1"/></foreignObject></svg>') == [
        ("foreignobject", "", "foreign_object"), ("svg", "onload", "event_handler"),
    ]
    assert found(spark, '<a href="javascript:x">t</a>') == [("a", "href", "javascript_href")]
    assert found(spark, '<p style="width:expression(1)">') == [("p", "style", "css_expression")]
    assert found(spark, '<set attributeName="x"/>') == [("set", "", "set_element")]
    assert found(spark, '<animate begin="click"/><animate begin="2s"/>') == [("animate", "", "animation_with_script")]
    assert found(spark, "<script>if (a<b) { x('<p onclick=\"q\">') }</script><SCRIPT src='x'/>") == [("script", "", "script_element")] * 2
    assert found(spark, '<a xlink:href="http://e.example">') == [("a", "xlink:href", "external_resource")]
    assert found(spark, '<i data-x="data:text/javascript,1">') == [("i", "data-x", "data_uri_script")]
    assert found(spark, '<p title="ok">onclick="text"</p><scripted>x</scripted>') == []


def test_sanitised_markup_is_safe(spark):
    html = (
        '<div onclick="a()" class="k"><script>x</script>text onclick="t" <a href="javascript:1" id="z">l</a>'
        '<set attributeName="q"/><script>never closed <b>'
    )
    clean = H.sanitize_markup(pages(spark, html), "html").first().clean_html
    assert "script" not in clean and 'class="k"' in clean and 'text onclick="t" ' in clean and 'id="z"' in clean
    assert H.is_safe_markup(pages(spark, clean), "id", "html").first().is_safe


def test_document_tokens(spark):
    raw = b"%PDF-1.4\n\xe9 /JS (app.alert(1)) /OpenAction /AA  << /O 1 >> /URI (https://x) /URI (ftp://x) /S /SubmitForm"
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"no header /JS (x)")), (3, None)], "id int, content binary")
    got = {(r.id, r.token): r.offset for r in H.scan_tokens(df, "id").collect()}
    assert got == {
        (1, "javascript"): raw.index(b"/JS"), (1, "open_action"): raw.index(b"/OpenAction"), (1, "additional_actions"): raw.index(b"/AA"),
        (1, "uri_action"): raw.index(b"/URI (https"), (1, "submit_form"): raw.index(b"/S /Submit"),
        (2, "not_scanned"): -1, (3, "not_scanned"): -1,
    }
    why = {r.id: r.found for r in H.scan_tokens(df, "id", max_bytes=20).collect() if r.token == "not_scanned"}
    assert why == {1: "too_large", 2: "no_header", 3: "no_content"}


def test_markup_probes(spark):
    assert found(spark, '<a title=">" onclick="evil()">x</a>') == [("a", "onclick", "event_handler")]
    assert found(spark, "<img onerror=alert(1)>") == [("img", "onerror", "event_handler")]
    assert found(spark, "<a href='java&#115;cript:x'>") == [("a", "href", "javascript_href")]
    assert found(spark, "<a href='java&#x73;cript&colon;x'>") == [("a", "href", "javascript_href")]
    assert found(spark, "<img alt=it's onerror=alert(1)>") == [("img", "onerror", "event_handler")]
    nested = "a<script><script>a</script>evil()</script>b"
    assert found(spark, nested) == [("script", "", "script_element")]
    assert H.sanitize_markup(pages(spark, nested), "html").first().clean_html == "ab"
    long = "<p title='" + "x>" * 20000 + "' onload=y()>t</p>"
    assert found(spark, long) == [("p", "onload", "event_handler")]
    assert H.sanitize_markup(pages(spark, long), "html").first().clean_html == long.replace("onload=y()", "")


def verdict(spark, rows, mode, fail_open=False):
    df = spark.createDataFrame([(1, i, v, s) for i, (v, s) in enumerate(rows)], "id int, ord int, verdict string, severity int")
    r = H.combine_verdicts(df, "id", mode, fail_open).first()
    return r.verdict, r.severity


def test_verdict_modes(spark):
    mixed = [("clean", 0), ("infected", 3), ("timeout", 0)]
    assert verdict(spark, mixed, "any_infected") == ("infected", 3)
    assert verdict(spark, mixed, "consensus") == ("error", 0)
    assert verdict(spark, mixed, "consensus", True) == ("clean", 0)
    assert verdict(spark, mixed, "first_responder") == ("clean", 0)
    assert verdict(spark, [("error", 0), ("infected", 2)], "first_responder") == ("infected", 2)
    assert verdict(spark, [("error", 0), ("infected", 2)], "consensus") == ("infected", 2)
    assert verdict(spark, [("error", 0), ("timeout", 0)], "aggregate_all") == ("error", 0)
    assert verdict(spark, [("timeout", 0)], "first_responder", True) == ("clean", 0)


def test_types(spark):
    rows = [
        (1, b"%PDF-1.4", "a.txt"), (2, b"\x89PNG\r\n\x1a\n", "b.png"), (3, b"PK\x03\x04", "c.xlsx"), (4, b"plain", "d.CSV"),
        (5, b"plain", "noext"), (6, None, None),
    ]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), n) for i, c, n in rows], "id int, content binary, name string")
    got = {r.id: (r.detected_ext, r.confidence) for r in T.detect_type(df, "content", "name").collect()}
    assert got == {1: ("pdf", 1.0), 2: ("png", 1.0), 3: ("docx", 1.0), 4: ("csv", 0.3), 5: ("unknown", 0.0), 6: ("unknown", 0.0)}
    assert T.detect_type(df, "content", "name", prefer_extension=True).where("id = 3").first().detected_ext == "xlsx"
    assert [r.id for r in T.type_mismatch(df, "content", "name").where("mismatch").collect()] == [1, 3]


def test_encodings(spark):
    text = "日本語のテキスト、漢字とかな。" * 4
    rows = [
        ("utf8", text.encode()), ("bom", b"\xef\xbb\xbfx"), ("u16", text.encode("utf-16-le", "ignore")[:0] + b"\xff\xfe" + text.encode("utf-16-le")),
        ("jis", text.encode("iso2022_jp")), ("sjis", text.encode("shift_jis")), ("euc", text.encode("euc_jp")), ("short", b"\xff"),
    ]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "n string, content binary")
    got = {r.n: r.encoding for r in T.detect_encoding(df, "content", fallback="windows-1252").collect()}
    assert got["utf8"] == "UTF-8" and got["bom"] == "UTF-8" and got["u16"] == "UTF-16LE" and got["jis"] == "ISO-2022-JP"
    assert got["sjis"] == "Shift_JIS" and got["short"] == "windows-1252"


def test_entropy(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("abcd" * 10,), (None,)], "t string")
    assert [r.entropy for r in T.entropy(df, "t").collect()] == [0.0, 0.0, 1.0, 2.0, None]
    noisy = "a" * 2048 + "".join(chr(33 + i % 90) for i in range(2048))
    row = T.entropy_anomaly(spark.createDataFrame([(1, noisy), (2, "short")], "id int, t string"), "id", "t", 256).orderBy("id").collect()
    assert row[0].anomaly and 0.3 < row[0].confidence <= 0.75 and not row[1].anomaly
    assert math.isclose(row[0].entropy, T._shannon(noisy.encode()))


def test_archive_rules(spark):
    df = spark.createDataFrame([("../x.txt", 0, 1), ("/a.pdf", 5, 1), ("b.exe", 0, 1), ("c.txt", 0, 200 * 2**20), ("ok.pdf", 4, 1)], "entry_name string, depth int, uncompressed_size bigint")
    got = [tuple(r.violations) for r in T.check_entries(df).collect()]
    assert got == [("path_traversal",), ("path_traversal", "too_deep"), ("executable", "extension_not_allowed"), ("too_large",), ()]


def test_glob_and_downgrade(spark):
    import re

    rx = re.compile(T.glob_regex("*.docx; *.xls?"))
    assert rx.match("dir/A.DOCX") and rx.match("b.xlsm") and not rx.match("c.xls") and not rx.match("d.docx.bak")
    df = spark.createDataFrame([("a.b.XLSM",), ("x.pdf",)], "n string")
    assert [r.safe_name for r in T.downgrade(df, "n").collect()] == ["a.b.xlsx", "x.pdf"]


def test_macro_allowlist(spark):
    parts = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, code string")
    allowed = spark.createDataFrame([(hashlib.sha256(b"good").hexdigest(),)], "sha256 string")
    got = {r.id: r.macro_action for r in T.macro_allowlist(parts, allowed, "code").collect()}
    assert got == {1: "allow", 2: "block"}


def test_rates(spark):
    df = spark.createDataFrame([("0/min",), ("60/min",), ("5/hour",), ("x",)], "r string")
    assert [r[0] for r in df.select(H.parse_rate(F.col("r"))).collect()] == [-1, 60, None, None]


def test_mail_zone_without_domains(spark):
    df = spark.createDataFrame([(1, "a@x", "b@x")], "id int, s string, r string")
    assert H.mail_zone(df, "id", "s", "r", []).first().zone == "external_to_external"
    assert H.mail_zone(df, "id", "s", "r", ["@X"]).first().zone == "internal_to_internal"


def test_byte_pairs_equal_a_walk():
    """Scores by places in runs of lead bytes equal those of a walk from left to right; also on real texts."""
    import random

    from tidewall.operators import files

    def walk(data):
        good, i = {"s": 0, "e": 0}, 0
        while i < len(data):
            kind = "s" if files.SJIS_LEAD[data[i]] else "e" if files.EUC_LEAD[data[i]] else None
            if kind:
                trail = files.SJIS_TRAIL if kind == "s" else files.EUC_TRAIL
                good[kind] += i + 1 == len(data) or bool(trail[data[i + 1]])
                i += 1
            i += 1
        return float(good["s"]), float(good["e"])

    rng = random.Random(3)
    cases = [b"", b"\x81", b"a\xa1", "日本語のテキスト".encode("shift_jis"), "日本語のテキスト、漢字".encode("euc_jp")]
    cases += [bytes(rng.choice([rng.randrange(256), rng.randrange(128, 256), 65]) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for data in cases:
        assert files._japanese_scores(data) == walk(data), data


def test_window_entropies_equal_one_by_one():
    import random

    from tidewall.operators import files

    rng = random.Random(4)
    for n, win, most in ((64, 32, 4096), (1000, 64, 3), (999, 33, 4), (70, 35, 4096), (5000, 512, 2)):
        data = bytes(rng.choice([rng.randrange(256), 65, 66]) for _ in range(n))
        want = [files._shannon(data[s : s + win]) for s in range(0, n - win + 1, win // 2)]
        assert list(files._window_entropies(data, win, most)) == pytest.approx(want, abs=1e-9)


def test_declared_encodings_come_before_any_guess(spark):
    from tidewall.operators import files

    sjis, euc = "日本語のテキスト".encode("shift_jis"), "日本語".encode("euc_jp")
    rows = [
        (0, sjis, "x-sjis", "Shift_JIS", 1.0), (1, euc, "EUC-JP", "EUC-JP", 1.0), (2, b"plain", "iso-8859-1", "windows-1252", 1.0), (3, b"plain", None, "UTF-8", 1.0),
        (4, b"plain", "nonsense", "UTF-8", 1.0), (5, b"\xff\xfea\x00", "utf-8", "UTF-16LE", 1.0), (6, b"\xe9t\xe9", "utf-8", "UTF-8", 0.3), (7, "é".encode(), " Latin1 ", "windows-1252", 1.0),
        (8, b"\x1b$B$3\x1b(B", "", "ISO-2022-JP", 0.95), (9, b"\x1b$B$3\x1b(B", "iso-2022-jp", "ISO-2022-JP", 1.0), (10, None, "utf-8", "UTF-8", 0.3),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, content binary, said string")
    got = {r.id: (r.encoding, r.encoding_confidence) for r in files.detect_encoding(df, "content", declared="said").collect()}
    assert got == {r[0]: r[3:] for r in rows}
    assert files.detect_encoding(df, "content").columns == ["id", "content", "said", "encoding", "encoding_confidence", "is_unicode"]
