"""Key files and configurations through the user's side."""

from netloom.api import Engine
from netloom.functions import times
from netloom.sources import keys

from .test_protocols import captured, talk, tls_capture  # noqa: F401  the fixture is shared


def test_key_files_of_a_folder(spark, tls_capture, tmp_path):  # noqa: F811
    files, log = tls_capture
    (tmp_path / "tls.key").write_text("\n".join(r.line for r in log.collect()) + "\n")
    (tmp_path / "xor.key").write_text("XOR_KEY 5aa501\n")
    assert [(r.path.rsplit("/", 1)[1], bytes(r.key)) for r in keys.xor_keys(spark, str(tmp_path)).collect()] == [("xor.key", b"\x5a\xa5\x01")]
    assert keys.pem_keys(spark, str(tmp_path)).count() == 0
    clear = b"GET /hidden.txt HTTP/1.1\r\nHost: plain.test\r\n\r\n"
    hidden = bytes(c ^ b"\x5a\xa5\x01"[i % 3] for i, c in enumerate(clear))
    both = files.unionByName(captured(talk(spark, [(True, hidden)], 7777, path="q.pcap", client_port=45_000)))
    config = f'[general]\nsortby = "/domain/"\n[keys]\nkeyfiles = ["{tmp_path}/tls.key", "{tmp_path}/xor.key"]\n[[decode.xor.properties]]\ndstPort = "7777"\nkeyfile = "xor.key"\n'
    e = Engine.open(spark, captures=both, config=config)
    rows = e.listing(show_metadata=True).collect()
    assert {(r.directory, r.file_type) for r in rows if r.file_type == "http"} == {("/test.org", "http"), ("/plain.test", "http")} and e.sortby == "/domain/"
    assert {(r.file_type, r.parsed) for r in e.files.collect() if r.file_type in ("tcp", "xor", "tls")} == {("tcp", True), ("xor", True), ("tls", True)}
    e.close()
    # Rules that fit nothing leave sessions closed.
    e = Engine.open(spark, captures=files, keys=str(tmp_path), rules={"tls": [{"dstPort": "1"}]})
    assert {r.file_type for r in e.files.collect()} == {"tcp", "tls"}
    e.close()


def test_times_as_a_listing_shows_them(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(times.shown(F.timestamp_seconds(F.lit(1_700_000_000))).alias("t")).first()
    assert r.t == "2023-11-14 10:13:20 PM"
