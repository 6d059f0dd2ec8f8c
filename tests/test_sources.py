from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.sources import connectors, documents, eventlog, indicators, lists, sinks


def raw(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "raw string")


def test_event_log(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    assert eventlog.read_events(spark, str(path)).count() == 0
    path.write_text('{"event_id":"evt_000001","event_time":"2024-01-01T00:00:00Z","run_id":"r","entity_type":"source","entity_id":"s","event_type":"discovered","payload":{"a":null}}\n\n')
    got = eventlog.read_events(spark, str(path)).collect()
    assert len(got) == 1 and got[0].payload == '{"a":null}'
    path.write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        eventlog.read_events(spark, str(path)).collect()


def test_artifact_files(spark, tmp_path):
    for name, doc in {"b.json": {"line_items": None, "periods": []}, "a.json": {"entities": []}, "c.json": {"x": 1}, "_merged.json": {}, "source_inventory.json": {}}.items():
        (tmp_path / name).write_text(json.dumps(doc))
    assert rows(eventlog.read_artifacts(spark, str(tmp_path)).select("file_name", "kind")) == [("a.json", "product"), ("b.json", "financial"), ("c.json", "extracted")]
    with pytest.raises(FileNotFoundError):
        eventlog.read_document(spark, str(tmp_path / "none.json"), "manifest")
    assert eventlog.read_document(spark, str(tmp_path / "none.json"), "manifest", strict=False).count() == 0


def test_sdn_csv(spark, tmp_path):
    path = tmp_path / "sdn.csv"
    path.write_bytes('36,"AEROCARIBBEAN",-0- ,"CUBA] [IRAN",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,"aka AERO CARIB; Linked To: X"\r\n7,"MÜLLER, Hans","individual","SDGT"\r\n'.encode("latin-1"))
    got = lists.sdn_csv(spark, str(path))
    assert rows(got.select("entry_id", "name", "type", "program", "aliases")) == [("36", "AEROCARIBBEAN", "", "CUBA; IRAN", ["AERO CARIB"]), ("7", "MÜLLER, Hans", "individual", "SDGT", [])]


def test_un_xml(spark, tmp_path):
    path = tmp_path / "un.xml"
    path.write_text("<C><INDIVIDUALS><INDIVIDUAL><DATAID>0012</DATAID><FIRST_NAME>A</FIRST_NAME><SECOND_NAME></SECOND_NAME><THIRD_NAME>C</THIRD_NAME><UN_LIST_TYPE>T</UN_LIST_TYPE><INDIVIDUAL_ALIAS><ALIAS_NAME>X</ALIAS_NAME></INDIVIDUAL_ALIAS></INDIVIDUAL></INDIVIDUALS><ENTITIES><ENTITY><DATAID>5</DATAID><FIRST_NAME>Org</FIRST_NAME></ENTITY></ENTITIES></C>")
    assert rows(lists.un_xml(spark, str(path)).select("entry_id", "name", "type", "program", "aliases")) == [("0012", "A C", "individual", "T", ["X"]), ("5", "Org", "entity", "", [])]


def test_bis_json(spark):
    got = lists.bis_json(raw(spark, {"results": [{"id": "1", "name": "N", "source": "S", "programs": ["A", "B"], "alt_names": [" x ", ""]}, None, {"id": "2"}]}))
    assert rows(got.select("entry_id", "name", "type", "program", "aliases")) == [("1", "N", "S", "A; B", ["x"]), ("2", "", "", "", [])]


def test_eu_csv(spark, tmp_path):
    path = tmp_path / "eu.csv"
    path.write_text("﻿Entity_logical_id;Subject_type;Programme;Naal_wholename;Entity_logical_id\n7;P;UKR;First Name;\n7;P;UKR;Second Name;\n7;P;UKR;;9\n8;E;SYR;Org;\n;P;X;Nobody;\n", encoding="utf-8")
    assert rows(lists.eu_csv(spark, str(path)).select("entry_id", "name", "type", "program", "aliases")) == [("7", "First Name", "P", "UKR", ["Second Name"]), ("8", "Org", "E", "SYR", [])]
    path.write_text("a;b\n1;2\n")
    assert lists.eu_csv(spark, str(path)).count() == 0


def test_uk_csv(spark, tmp_path):
    path = tmp_path / "uk.csv"
    path.write_text("Report date,x\nUnique ID,OFSI Group ID,Name 6,Name 1,Name 2,Name type,Type of entity,Regime Name\nU1,,Alias,An,,Alias,Person,R1\nU1,,Smith,John,Q,Primary Name,Person,R2\n,G2,Only,,,Alias,Ship,R3\n")
    assert rows(lists.uk_csv(spark, str(path)).select("entry_id", "name", "type", "program", "aliases")) == [("G2", "Only", "Ship", "R3", []), ("U1", "John Q Smith", "Person", "R1", ["An Alias"])]


def test_indicators(spark):
    bls = indicators.bls(raw(spark, {"status": "REQUEST_SUCCEEDED", "Results": {"series": [{"seriesID": "S", "data": [{"year": "2026", "period": "M05", "periodName": "May", "value": "1.5"}, {"year": "2026", "period": "M04", "value": "-"}]}]}}))
    assert rows(bls.select("series", "period", "value", "label")) == [("S", "2026-M04", None, None), ("S", "2026-M05", 1.5, "May")]
    with pytest.raises(Exception, match="not successful"):
        indicators.bls(raw(spark, {"status": "REQUEST_NOT_PROCESSED"})).collect()
    wb = indicators.world_bank(raw(spark, [{"page": 1}, [{"indicator": {"id": "I", "value": "L"}, "countryiso3code": "NOR", "date": "2023", "value": None}]], {"message": "x"}))
    assert rows(wb.select("series", "area", "period", "value", "label")) == [("I", "NOR", "2023", None, "L")]
    cube = {"label": "GDP", "id": ["na_item", "geo", "time"], "size": [1, 2, 2], "value": {"0": 1, "3": 4.5, "x": 9}, "dimension": {"na_item": {"category": {"index": {"B1": 0}}}, "geo": {"category": {"index": {"DE": 0, "FR": 1}}}, "time": {"category": {"index": {"2022": 0, "2023": 1}}}}}
    assert rows(indicators.eurostat(raw(spark, cube)).select("series", "area", "period", "value")) == [("B1", "DE", "2022", 1.0), ("B1", "FR", "2023", 4.5)]
    assert indicators.eurostat(raw(spark, cube | {"size": [1]})).count() == 0
    sdmx = {"data": {"structures": [{"name": "N", "dimensions": {"observation": [{"id": "REF_AREA", "values": [{"id": "AT"}, {"id": "BE"}]}, {"id": "MEASURE", "values": [{"id": "M"}]}, {"id": "TIME_PERIOD", "values": [{"id": "2020"}]}]}}], "dataSets": [{"observations": {"1:0:0": [7, 1], "5:0": [8]}}]}}
    assert rows(indicators.oecd(raw(spark, sdmx)).select("series", "area", "period", "value")) == [("M", "", None, 8.0), ("M", "BE", "2020", 7.0)]


def test_registers(spark):
    no = {"_embedded": {"enheter": [{"organisasjonsnummer": "9", "navn": "N", "konkurs": True, "forretningsadresse": {"adresse": ["St 1", ""], "postnummer": "01", "poststed": "Oslo", "land": "Norge"}}, {"navn": "M"}]}}
    assert rows(connectors.brreg(raw(spark, no)).select("reg_number", "name", "status", "address")) == [("", "M", "active", None), ("9", "N", "bankrupt", "St 1, 01 Oslo, Norge")]
    assert rows(connectors.ares(raw(spark, {"ico": "1", "obchodniJmeno": "X"}, {"x": 1})).select("reg_number", "name", "status")) == [("1", "X", None)]
    fi = {"companies": [{"businessId": {"value": "1-2"}, "names": [{"name": "Old", "endDate": "2020"}, {"name": "New"}]}, {"names": [{"name": "Gone", "endDate": "2020"}]}, {}]}
    assert rows(connectors.prh(raw(spark, fi)).select("reg_number", "name")) == [("", ""), ("", "Gone"), ("1-2", "New")]
    assert rows(connectors.ariregister(raw(spark, {"data": [{"reg_code": 5, "name": "E", "legal_address": "A", "zip_code": "1", "url": "u"}]})).select("reg_number", "address", "url")) == [("5", "A, 1", "u")]
    assert rows(connectors.gleif(raw(spark, {"data": [{"attributes": {"lei": "L", "entity": {"legalName": {"name": "N"}, "legalAddress": {"country": "NO"}, "status": "ACTIVE"}}}]}))) == [("L", "N", "NO", "ACTIVE")]
    assert rows(connectors.companies_house(raw(spark, {"items": [{"company_number": "1", "title": "T"}]}))) == [("1", "T", "", "")]


def test_search_services(spark):
    assert rows(connectors.gdelt(raw(spark, {"articles": [{"url": "u"}]}, " "))) == [("u", "", "", "", "")]
    with pytest.raises(Exception, match="non-JSON"):
        connectors.gdelt(raw(spark, "Please limit requests")).collect()
    assert rows(connectors.wikidata_search(raw(spark, {"search": [{"id": "Q1", "label": "", "display": {"label": {"value": "L"}}}]}))) == [("Q1", "L", "")]
    snak = lambda t, v: {"mainsnak": {"snaktype": "value", "datavalue": {"type": t, "value": v}}}
    doc = {"entities": {"Q1": {"claims": {"P17": [snak("wikibase-entityid", {"id": "Q20"}), {"mainsnak": {"snaktype": "novalue"}}], "P856": [snak("string", "http://x")], "P571": [snak("globecoordinate", {})], "P999": [snak("string", "no")]}}}}
    got = connectors.wikidata_facts(raw(spark, doc).withColumn("qid", F.lit("Q1"))).collect()[0]
    assert got.facts == {"country": ["Q20"], "official_website": ["http://x"]}
    filings = {"filings": {"recent": {"accessionNumber": ["1", "2"], "form": ["10-K", "8-K"], "filingDate": ["d1", "d2"], "primaryDocDescription": ["x", "y"]}}}
    assert rows(connectors.edgar_filings(raw(spark, filings))) == [("1", "10-K", "d1", "x")]


def test_guards_and_saved_responses(spark, tmp_path):
    assert connectors.is_public("https://example.com/", ["93.184.216.34"])
    for url, addresses in (("ftp://x", ["93.184.216.34"]), ("http://x", ["10.0.0.1"]), ("http://x", ["::ffff:127.0.0.1"]), ("http://169.254.169.254/", ["93.184.216.34"]), ("http://x", []), ("http://x", ["93.184.216.34", "127.0.0.1"])):
        assert not connectors.is_public(url, addresses)
    with pytest.raises(connectors.Unavailable):
        connectors.fetch_rows(spark.createDataFrame([("u",)], "url string"))
    (tmp_path / "r.json").write_text('{"items": []}')
    spark.dataSource.register(connectors.SavedResponses)
    assert spark.read.format("saved_responses").option("paths", str(tmp_path / "r.json")).load().collect()[0].raw == '{"items": []}'
    assert connectors.query_url("b", {"geo": ["DE", "FR"]}) == "b?geo=DE&geo=FR" and connectors.basic_auth("k") == "Basic azo="
    assert isinstance(connectors.capabilities(), dict)


def test_html_tables(spark):
    docs = spark.createDataFrame([(1, "<table><tr><td>a</td><td>b</td></tr></table>"), (2, None)], "id int, html string")
    assert rows(documents.html_tables(docs, "id", "html")) == [(1, 0, 0, ["a", "b"])]
    with pytest.raises(connectors.Unavailable):
        documents.pdf_tables()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", None)], "id int, name string, email string")
    sinks.csv_file(df, str(tmp_path / "x.csv"), ["name", "id", "email"], redacted=["email"])
    assert (tmp_path / "x.csv").read_bytes() == b"name,id,email\r\na|b,1,[REDACTED]\r\n"
    sinks.markdown(df, str(tmp_path / "x.md"), ["id", "name"], "T")
    assert (tmp_path / "x.md").read_text() == "# T\n\n| id | name |\n| --- | --- |\n| 1 | a\\|b |\n"
    sinks.jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).collect()[0].value == '{"email":null,"id":1,"name":"a|b"}'
    event = ("evt_000001", "t", "r", "source", "s", "discovered", "{}")
    schema = "event_id string, event_time string, run_id string, entity_type string, entity_id string, event_type string, payload string"
    sinks.append_events(spark.createDataFrame([event], schema), str(tmp_path / "log"))
    with pytest.raises(ValueError, match="event_type"):
        sinks.append_events(spark.createDataFrame([(*event[:5], "nonsense", "{}")], schema), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 1
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a.json").write_text("{}")
    assert not sinks.publish(str(tmp_path / "run"), str(tmp_path / "latest"), ["a.json"], passed=False)
    assert sinks.publish(str(tmp_path / "run"), str(tmp_path / "latest"), ["a.json", "b.json"], passed=True) and (tmp_path / "latest" / "a.json").exists()
    with sinks.company_lock(str(tmp_path), "me"), pytest.raises(RuntimeError), sinks.company_lock(str(tmp_path), "you"):
        pass


def test_runs_and_list_screening(spark, tmp_path):
    from datetime import datetime

    from ledgerloom.functions import dates
    from ledgerloom.sources import runs

    run = runs.create_run(str(tmp_path), "acme", "full_refresh", datetime(2024, 5, 6, 7, 8, 9), "ab12")
    assert run.name == "20240506T070809Z-ab12" and (run / "structured").is_dir() and json.loads((run / "run_manifest.json").read_text())["mode"] == "full_refresh"
    with pytest.raises(FileExistsError):
        runs.create_run(str(tmp_path), "acme", "full_refresh", datetime(2024, 5, 6, 7, 8, 9), "ab12")
    for mode, token in (("nonsense", "ab12"), ("full_refresh", "AB")):
        with pytest.raises(ValueError):
            runs.create_run(str(tmp_path), "acme", mode, datetime(2024, 1, 1), token)
    (tmp_path / "bis.json").write_text(json.dumps({"results": [{"id": "1", "name": "Acme Bad Corp"}]}))
    asked = spark.createDataFrame([("ACME, bad corp",), ("bad corp",), ("bad",)], "query string")
    assert rows(runs.screen_list(asked, "BIS-CSL", str(tmp_path / "bis.json"))) == [("ACME, bad corp", "1", "exact"), ("bad corp", "1", "partial")]
    with pytest.raises(ValueError, match="unknown list"):
        runs.screen_list(asked, "NONE", "x")
    report = spark.createDataFrame([("b", 1, False, 2), ("a", 0, True, 0)], "gate string, ordinal int, passed boolean, n_problems int")
    assert "- a: PASS — 0 problems\n- b: FAIL — 2 problems" in runs.report_markdown(report)
    t = spark.createDataFrame([("2024-05-06T07:08:09Z", "junk")], "a string, b string").select(dates.iso_utc(dates.parse_iso(F.col("a"))), dates.compact_stamp(dates.parse_iso(F.col("a"))), dates.older_than(F.col("a"), F.lit("2024-12-01").cast("timestamp"), 180), dates.older_than(F.col("b"), F.lit("2024-12-01").cast("timestamp"), 180))
    assert rows(t) == [("2024-05-06T07:08:09Z", "20240506T070809Z", True, False)]


def test_list_files_with_quoted_line_breaks_and_nameless_groups(spark, tmp_path):
    path = tmp_path / "uk.csv"
    path.write_text('Report date,x\nUnique ID,Name 6,Name 1,Name type,Type of entity,Regime Name\nU1,,,Alias,First,R1\nU1,"Smith, the ""Elder""\nof X",,Alias,Person,R2\nU1,Boss,,Primary name,Person,R3\nU2,,,Primary name,Ship,R4\n')
    assert rows(lists.uk_csv(spark, str(path)).select("entry_id", "name", "type", "program", "aliases")) == [("U1", "Boss", "First", "R1", ['Smith, the "Elder" of X']), ("U2", "", "Ship", "R4", [])]
    path.write_text('Entity_logical_id;Naal_wholename;"Pro;gramme";Subject_type\n1;"A;\nB";x;P\n1;C;y;E\n')
    assert rows(lists.eu_csv(spark, str(path)).select("entry_id", "name", "type", "aliases")) == [("1", "A;\nB", "P", ["C"])]


def test_guarded_get():
    pages = {"https://a.example/": (302, {"Location": "/b"}, b""), "https://a.example/b": (200, {"Content-Type": "text/x"}, b"body"), "https://loop.example/": (301, {"location": "https://loop.example/"}, b""), "https://in.example/": (302, {"location": "http://10.0.0.1/"}, b"")}
    asked = []

    def client(url, headers):
        asked.append((url, headers["User-Agent"]))
        return pages[url]

    hosts = {"a.example": ["93.184.216.34"], "loop.example": ["93.184.216.34"], "in.example": ["93.184.216.34"], "10.0.0.1": ["10.0.0.1"]}
    assert connectors.guarded_get("https://a.example/", client, hosts.__getitem__, agent=" me ") == (b"body", {"status": 200, "content_type": "text/x", "final_url": "https://a.example/b"})
    assert asked[-1] == ("https://a.example/b", "me") and connectors.user_agent(" ") == connectors.AGENT
    for url, most, why in (("https://loop.example/", 9, "redirects"), ("https://in.example/", 9, "not a public"), ("https://a.example/b", 3, "bytes"), ("ftp://a.example/", 9, "not a public")):
        with pytest.raises(connectors.Unavailable, match=why):
            connectors.guarded_get(url, client, hosts.__getitem__, most_bytes=most)


def test_lock_publish_history_and_manifest(tmp_path):
    import json

    from ledgerloom.sources import runs

    with sinks.company_lock(str(tmp_path), "a", now=1000.0):
        with pytest.raises(RuntimeError, match="locked"), sinks.company_lock(str(tmp_path), "b", now=1001.0):
            pass
        with sinks.company_lock(str(tmp_path), "c", now=9999.0):  # the first one is stale by then
            assert json.loads((tmp_path / ".lock").read_text())["owner"] == "c"
    assert not list(tmp_path.glob(".lock*"))
    run = runs.create_run(str(tmp_path), "acme", "full_refresh", datetime(2024, 5, 6, 7, 8, 9), "ab12", name="Acme")
    manifest = json.loads((run / "run_manifest.json").read_text())
    assert manifest["company_name"] == "Acme" and manifest["started_at"] == "2024-05-06T07:08:09Z" and manifest["reproducibility"]["locale"] is None
    assert sinks.publish(str(run), str(tmp_path / "latest"), ["run_manifest.json", "gone.json"], passed=True, history=str(tmp_path / "history"), published_at="t")
    assert json.loads((tmp_path / "history" / f"{run.name}.json").read_text()) == {"run_id": run.name, "published_at": "t", "passed": True}


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from ledgerloom import session

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="must name a folder"):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x")))


def test_large_cubes_have_exact_positions(spark):
    got = spark.range(1).select(indicators.positions(F.lit((1 << 60) + 7).cast("long"), F.array(F.lit(1 << 31), F.lit(1 << 20), F.lit(1 << 10)).cast("array<long>")).alias("p")).collect()[0].p
    assert got == [1 << 30, 0, 7]
