"""Rules of the ledger engine on literal rows."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions import scalars as S
from tallyloom.operators import gates, mapping, metadata, privacy, tax, tenants
from tallyloom.operators import ledger as L
from tallyloom.operators import medallion as M
from tallyloom.plans import jobs
from tallyloom.sources import files, sinks, tables, workbook
from tallyloom.streaming import watch


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_dates(spark):
    day = dt.date(2024, 3, 15)
    texts = ["15/03/2024", "2024-03-15", "03/15/2024", "15-Mar-2024", "15-03-2024", " 15/03/2024 ", "not-a-date", "", None]
    assert column(spark, S.parse_date, texts) == [day] * 6 + [None] * 3
    assert column(spark, S.parse_date, ["03/04/2024"]) == [dt.date(2024, 4, 3)]


def test_dates_are_those_of_the_parser(spark):
    days, months, years = ("1", "01", "15", "31", "32", "0", "007", "+5"), ("2", "02", "13", "12", "00", "Feb", "FEB", "february", "Sept", "xyz"), ("2024", "24", "02024", "2023")
    texts = [a + s + b + s + c for s in "-/ " for a in days for b in months for c in years] + [c + s + b + s + a for s in "-/" for a in days for b in months for c in years]
    texts += [" 15/03/2024\t", "\n", "15/03-2024", "15//03/2024", "15-Mar-2024 10:00", "2024-03-15T00:00:00", "x15/03/2024", "٠١/٠٢/٢٠٢٤", "15  Mar 2024"]
    for formats in (fixed.DATE_FORMATS, fixed.SHORT_DATE_FORMATS, fixed.MONTH_FIRST_FORMATS, ("M/d/yyyy",), ("d MMM yyyy",)):
        want = lambda c, formats=formats: F.coalesce(*(F.try_to_date(S.trimmed(c), f) for f in formats))
        got = zip(texts, column(spark, lambda c, f=formats: S.parse_date(c, f), texts), column(spark, want, texts), strict=True)
        # the parser also takes zeros in front of a number without end, which no file writes
        assert [(t, g, w) for t, g, w in got if g != w and "007" not in t and "02024" not in t] == []
    assert column(spark, lambda c: S.parse_date(c, fixed.MONTH_FIRST_FORMATS), ["03/04/2024", "15/04/2024"]) == [dt.date(2024, 3, 4), dt.date(2024, 4, 15)]
    assert column(spark, lambda c: S.parse_date(c, ("yyyyMMdd", "d/M/yyyy")), ["20240315", "15/03/2024"]) == [dt.date(2024, 3, 15)] * 2


def test_amounts(spark):
    assert column(spark, S.parse_amount, ["PKR 5,000", "(5,000)", "-200", "Rs. 12,500.50", "", None, "abc", "inf", "1_000", "5000d"]) == [5000.0, -5000.0, -200.0, 12500.5, None, None, None, None, None, None]
    assert column(spark, S.parse_amount_gate, ["PKR 45,000", "N/A", "5000 DR", "$10", "(5,000)"]) == [45000.0, None, 5000.0, 10.0, -5000.0]
    assert column(spark, S.parse_amount_or_zero, ["pkr 45,000", "x", "(5)", None]) == [45000.0, 0.0, -5.0, 0.0]


def test_periods_and_texts(spark):
    assert column(spark, S.fiscal_year, [dt.date(2024, 8, 1), dt.date(2025, 3, 1), None], "date") == ["2024-2025", "2024-2025", None]
    assert column(spark, S.language, ["Office", "کرایہ", "rent کرایہ", None]) == ["en", "ur", "mixed", "en"]
    assert column(spark, S.currency, ["Rs", "dollar", "xyz", None]) == ["PKR", "USD", "XYZ", None]
    assert column(spark, lambda c: S.amount_text(c, F.lit("PKR")), [5000.0, 1234567.89], "double") == ["PKR 5,000", "PKR 1,234,568"]
    assert column(spark, S.neutralised, ['=HYPERLINK("x")', "-5000", "+5", "-x", "a|b|c", "@x", "plain", None]) == ['FORMULA_REMOVED:=HYPERLINK("x")', "-5000", "+5", "FORMULA_REMOVED:-x", "FORMULA_REMOVED:a|b|c", "FORMULA_REMOVED:@x", "plain", None]


def test_masks_and_matches(spark):
    text = "CNIC 42101-1234567-9 call 03001234567 mail ahmed@company.pk"
    assert column(spark, lambda c: S.mask(c)[0], [text]) == ["CNIC *****-*******-* call ***PHONE*** mail ***EMAIL***"]
    assert column(spark, lambda c: S.mask(c, "pipeline")[0], [text]) == ["CNIC [CNIC] call [PHONE] mail ahmed@company.pk"]
    df = spark.createDataFrame([(text, "Ali 42101-1234567-9", None)], "description string, party_name string, reference string")
    row = privacy.mask_rows(privacy.scan(df)).first()
    assert [(m["type"], m["token"]) for m in row["pii"] if m["type"] == "CNIC"] == [("CNIC", "[CNIC_1]"), ("CNIC", "[CNIC_2]")]
    assert row["description"].startswith("CNIC [CNIC_1] call [PHONE_1] mail [EMAIL_1]")
    report = privacy.report(df.union(spark.createDataFrame([("x", "y", "z")], df.schema))).first()
    assert (report["rows_with_pii"], report["pii_percentage"]) == (1, 50.0)


def test_masks_by_place(spark):
    rows = [("Paid abroad on Mall road 03001234567 and 03001234567", "road", "PK36SCBL0000001123456702"), ("البلاد ٠٣٠٠١٢٣٤٥٦٧", None, None)]
    df = privacy.scan(spark.createDataFrame(rows, "description string, party_name string, reference string"))
    row, urdu = privacy.mask_rows(df).collect()
    assert row["description"] == "Paid abroad on Mall [ADDRESS_1] [PHONE_1] and [PHONE_2]" and row["party_name"] == "[ADDRESS_2]" and row["reference"] == "[IBAN_1]"
    assert "[ACCOUNT_NO_1]" in urdu["description"] and not any(ch in urdu["description"] for ch in "٣٤٥")
    compat = privacy.mask_rows(df, mode="compat").first()["description"]
    assert compat == "Paid ab[ADDRESS_1] on Mall [ADDRESS_1] [PHONE_1] and [PHONE_1]"
    with pytest.raises(ValueError, match="mode"):
        privacy.mask_rows(df, mode="other")


def test_canonical(spark):
    df = spark.createDataFrame([("15/03/2024", "Rent", "50000", "0"), ("16/03/2024", "Sale", "0", "80000"), (None, "x", "1", "0")], "Posting_Date string, Particulars string, Dr string, Cr string")
    got = [(r["description"], r["amount"], r["direction"], r["currency"]) for r in L.normalise(df).orderBy("txn_date").collect()]
    assert got == [("Rent", 50000.0, "debit", "PKR"), ("Sale", 80000.0, "credit", "PKR")]
    with pytest.raises(L.SchemaError, match="txn_date"):
        L.normalise(spark.createDataFrame([("a", "1")], "memo string, amount string"))
    assert L.normalise(df.limit(0)).count() == 0
    signed = spark.createDataFrame([("2024-01-01", "x", "-2500")], "date string, memo string, amount string")
    assert L.normalise(signed).first()["direction"] == "credit"
    assert L.normalise(signed, sign_rule="bank").first()["direction"] == "debit"
    slashed = spark.createDataFrame([("03/04/2024", "x", "1")], "date string, memo string, amount string")
    assert [L.normalise(slashed, date_order=o).first()["txn_date"].month for o in ("dmy", "mdy")] == [4, 3]
    # no format is tried by the parser, and the filter reads the settled date
    plan = L.normalise(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "gettimestamp" not in plan and plan.count("rlike") <= 6
    report = L.cleaning_report(L.normalise(df).withColumn("id", F.col("description")), ["id"]).first()
    assert (report["rows_before"], report["filled_parties"]) == (2, 2)


def test_silver_rows(spark):
    raws = ['{"date": "15/03/2024", "description": "Electricity bill payment", "debit": "PKR 5,000", "vendor": "WAPDA"}', '{"description": "Some payment", "debit": "1000"}', "nonsense", "[1]", None]
    rows = M.classified(spark.createDataFrame([(str(i), "b", r) for i, r in enumerate(raws)], "bronze_id string, ingestion_batch_id string, raw_content string"))
    good = M.silver(rows).collect()
    assert [(r["bronze_id"], r["amount_debit"], r["quality_score"], r["category"]) for r in good] == [("0", 5000.0, 1.0, "Utilities")]
    bad = {r["bronze_id"]: r["reason"] for r in M.quarantine(rows).collect()}
    assert bad == {"1": "date_parse_failed", "2": "invalid_json", "3": "invalid_json_structure", "4": "invalid_json"}
    gold = M.promoted(M.silver(rows)).first()
    assert gold["embedding_text"] == "On 15 Mar 2024, PKR 5,000 was paid to WAPDA — Utilities"


def test_months(spark):
    rows = spark.createDataFrame([("2024-01", "2023-2024", 5000.0, 0.0), ("2024-01", "2023-2024", 0.0, 20000.0), ("2024-02", "2023-2024", 80000.0, 0.0)], "year_month string, fiscal_year string, amount_debit double, amount_credit double")
    jan, feb = M.summaries(rows).orderBy("year_month").collect()
    assert (jan["total_income"], jan["total_expenses"], jan["transaction_count"], jan["vs_prior_period_pct"], jan["anomaly_flag"]) == (20000.0, 5000.0, 2, None, False)
    assert feb["vs_prior_period_pct"] == -633.33 and feb["anomaly_flag"]
    assert M.summaries(rows.limit(0)).count() == 0


def test_dictionary_and_tax(spark):
    asked = spark.createDataFrame([("Particulars", "tally"), ("تاریخ", None), ("Ref.No", None), ("xyzzy", None)], "header string, software string")
    got = {r["header"]: (r["target"], r["confidence"]) for r in mapping.exact(asked).collect()}
    assert got == {"Particulars": ("description", 0.95), "تاریخ": ("transaction_date", 0.9), "Ref.No": ("reference", 0.75), "xyzzy": (None, None)}
    assert mapping.fuzzy(spark.createDataFrame([("descripton",)], "header string")).first()["target"] == "description"
    names = spark.createDataFrame([("Consulting",), ("Fuel & Transport",), ("Utilities",), ("",), (None,)], "category string")
    found = {r["category"]: r["section_key"] for r in tax.classify(names).collect()}
    assert found == {"Consulting": "153_services", "Fuel & Transport": "153_services", "Utilities": None, "": None, None: None}
    paid = tax.withholding(spark.createDataFrame([("Rent", 1000.0), (None, 5.0)], "category string, amount double")).collect()
    assert sorted(r["wht"] for r in paid) == [0.0, 100.0]


def test_boundary_gates_tenants(spark):
    df = spark.createDataFrame([("a", 1, ("x", 2))], "description string, total int, totals struct<phone: string, income: int>")
    assert privacy.for_cloud(df).schema.simpleString() == "struct<total:int,totals:struct<income:int>>"
    with pytest.raises(privacy.BoundaryError):
        privacy.for_cloud(df, strict=True)
    deep = spark.sql("select array(named_struct('party_name', 'Landlord', 'total', 5.0), null) as top_parties, map('Income', 1, 'CNIC', 2, 'other', 3) as totals, array(named_struct('cnic', 'x')) as trends, map('net', named_struct('iban', 'y', 'count', 2)) as averages")
    safe = privacy.for_cloud(deep)
    assert safe.columns == ["top_parties", "totals", "averages"]
    assert safe.first().asDict(recursive=True) == {"top_parties": [{"total": 5}, None], "totals": {"Income": 1}, "averages": {"net": {"count": 2}}}
    assert set(privacy.for_cloud(deep, unknown="keep").first()["totals"]) == {"Income", "other"}
    assert gates.safe_names(spark.createDataFrame([(1, 2)], "Bronze_ID int, x int")).columns == ["raw_Bronze_ID", "x"]
    files_ = spark.createDataFrame([("a", 10), ("b", 10), ("c", 99)], "path string, length long")
    lines = spark.createDataFrame([("a", 1, "=CMD(x)", 1), ("a", 2, "e\u0301" * 3, 1), ("b", 3, "x", 1), ("b", 4, "x", 1), ("b", 5, "x", 1), ("c", 6, "x", 1)], "path string, row_id int, text string, gold_version int")
    clean, told, verdicts = gates.chain(files_, lines, "row_id", max_bytes=50, max_rows=2, most=18)
    assert clean.columns == ["path", "row_id", "text", "raw_gold_version"]
    assert {r["row_id"]: r["text"] for r in clean.collect()} == {1: "FORMULA_REMOVED:=C", 2: "é" * 3}
    assert [tuple(r) for r in told.collect()] == [(1, "formula", "text")]
    assert {r["path"]: r["blocked_by"] for r in verdicts.collect()} == {"a": None, "b": "rows", "c": "size"}
    assert gates.sanitised(spark.createDataFrame([("=CMD(x)" + "y" * 20000,)], "c string")).select(F.length("c")).first()[0] == 10_000
    with pytest.raises(ValueError):
        tenants.page(df, 501)
    orgs = spark.createDataFrame([(1,), (2,)], "org_id int")
    had = spark.createDataFrame([(1, "1000")], "org_id int, code string")
    assert tenants.seeded(orgs, had).count() == 71


def test_strict_boundary_looks_at_every_depth(spark):
    nested = "totals struct<income:int,Phone:string>, categories array<struct<name:string,iban:string>>, trends map<string,struct<net:int,email:string>>, vendor struct<email:string>, month string"
    df = spark.createDataFrame([], nested)
    with pytest.raises(privacy.BoundaryError) as told:
        privacy.for_cloud(df, strict=True)
    assert told.value.blocked == ["totals.Phone", "categories.iban", "trends.email", "vendor"]
    assert privacy.for_cloud(df, unknown="keep").schema.simpleString() == "struct<totals:struct<income:int>,categories:array<struct<name:string>>,trends:map<string,struct<net:int>>,month:string>"
    # keys of maps are data: dropped, and nothing to raise for
    keyed = spark.createDataFrame([({"income": 1, "cnic": 2},)], "totals map<string,int>")
    assert privacy.for_cloud(keyed, strict=True).first()["totals"] == {"income": 1}


def test_metadata(spark):
    rows = [("2026-01-05", "Landlord", 50000.0, "debit"), ("2026-01-15", "ABC Co", 80000.0, "credit"), ("2026-01-20", "WAPDA", 3500.0, "debit"), ("2026-02-05", "ABC Co", 65000.0, "credit"), ("2026-02-10", "PTCL", 5000.0, "debit")]
    df = spark.createDataFrame(rows, "d string, party_name string, amount double, direction string").withColumn("txn_date", F.to_date("d"))
    assert tuple(metadata.totals(df).select("income", "expenses", "net", "transaction_count").first()) == (145000.0, 58500.0, 86500.0, 5)
    assert metadata.document(df).first()["top_parties"][0]["party_name"] == "ABC Co"
    assert metadata.averages(df.limit(0)).first()["avg_income"] == 0.0


STANDARD = "Date,Description,Party,Amount,Type\n15/01/2024,Rent payment,Landlord,50000,debit\n16/01/2024,Sale to ABC Co,ABC Co,80000,credit\n17/01/2024,Electricity bill,,3500,debit\n18/01/2024,Payment with CNIC 12345-1234567-1,Ali Khan,5000,debit\n20/01/2024,,Unknown,1000,debit\nTotal,,,139500,\n"


def book(lines):
    """The bytes of a workbook of one sheet."""
    data = io.BytesIO()
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'
    body = "".join(f'<row r="{r + 1}">' + "".join(cell(f"{'ABCDE'[c]}{r + 1}", v) for c, v in enumerate(line)) + "</row>" for r, line in enumerate(lines))
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return data.getvalue()


def layer(spark, lake, name):
    return spark.read.parquet(f"{lake}/{name}")


def test_files_to_gold(spark, tmp_path):
    folder, lake = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    (folder / "standard.csv").write_text(STANDARD)
    (folder / "cp.csv").write_bytes("Name;City\nJohn;München\nAnna;Zürich\n".encode("cp1252"))
    (folder / "~$standard.csv").write_text("x")
    found = files.manifest(spark, str(folder), contents=True).where("path like '%standard%'")
    first = jobs.ingest(spark, found, lake, "b1")
    assert first == {"status": "ok", "bronze": 5, "silver": 5, "quarantine": 0, "gold": 5}
    silver = layer(spark, lake, "silver")
    assert tuple(silver.agg(F.sum("amount_debit"), F.sum("amount_credit")).first()) == (59500.0, 80000.0)
    assert silver.where("description_masked like '%[CNIC]%'").count() == 1
    rows = layer(spark, lake, "bronze").orderBy("source_row_number").collect()
    assert [(r["source_row_number"], r["raw_content"].split('"')[3]) for r in rows] == [(1, "15/01/2024"), (2, "16/01/2024"), (3, "17/01/2024"), (4, "18/01/2024"), (5, "20/01/2024")]
    assert set(layer(spark, lake, "summaries").columns) >= {"category_breakdown", "vs_prior_period_pct", "period_end"}
    assert jobs.ingest(spark, found, lake, "b2")["status"] == "duplicate"
    # the same batch again, as a stream replays it, leaves the same tables
    assert jobs.ingest(spark, found, lake, "b1") == first
    assert [layer(spark, lake, n).count() for n in ("bronze", "silver", "gold")] == [5, 5, 5]
    groups = files.csv_groups(files.manifest(spark, str(folder), contents=True).where("path like '%cp.csv'"))
    assert groups[0][:2] == ("windows-1252", ";")


def test_workbooks_and_files_of_one_header_go_together(spark, tmp_path):
    folder, lake = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    for i in range(4):
        (folder / f"f{i}.csv").write_text(STANDARD.replace("50000", f"5000{i}"))
    (folder / "book.xlsx").write_bytes(book([["Date", "Description", "Party", "Amount", "Type"], ["15/02/2024", "Rent", "Landlord", 7000, "debit"], ["16/02/2024", "Sale", "ABC Co", 900, "credit"], ["Total", "", "", 7900]]))
    (folder / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0 not a zip")
    found = files.manifest(spark, str(folder), contents=True)
    assert [len(paths) for _, _, paths in files.csv_groups(found)] == [4]
    done = jobs.ingest(spark, found, lake, "b1")
    assert (done["status"], done["bronze"], done["gold"]) == ("ok", 22, 22)
    only = jobs.ingest(spark, found.where("source_type = 'xlsx'"), str(tmp_path / "other"), "b1")
    assert only["status"] == "ok" and only["bronze"] == 2
    kinds = {(r["source_type"], r["source_software"]) for r in layer(spark, lake, "bronze").select("source_type", "source_software").distinct().collect()}
    assert kinds == {("csv", "manual_csv"), ("xlsx", "manual_excel")}


@pytest.mark.parametrize("dies_at", ["bronze", "gold"])
def test_a_run_that_dies_is_taken_up(spark, tmp_path, monkeypatch, dies_at):
    folder, lake = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    (folder / "a.csv").write_text(STANDARD)
    found = files.manifest(spark, str(folder), contents=True)
    real = sinks.replace_partitions

    def dying(df, path, by):
        if path.endswith(dies_at):
            raise OSError("lost")
        real(df, path, by)

    monkeypatch.setattr(sinks, "replace_partitions", dying)
    with pytest.raises(OSError, match="lost"):
        jobs.ingest(spark, found, lake, "b1")
    monkeypatch.setattr(sinks, "replace_partitions", real)
    assert jobs.ingest(spark, found, lake, "b2") == {"status": "ok", "bronze": 5, "silver": 5, "quarantine": 0, "gold": 5}
    assert jobs.ingest(spark, found, lake, "b3")["status"] == "duplicate"
    assert layer(spark, lake, "gold").count() == 5 and layer(spark, lake, "summaries").agg(F.sum("transaction_count")).first()[0] == 5


def test_watched_folder_goes_to_gold(spark, tmp_path):
    folder, lake = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    for i in range(2):
        (folder / f"f{i}.csv").write_text(STANDARD.replace("50000", f"5000{i}"))
        watch.run(watch.arrivals(spark, str(folder)), jobs.watcher(spark, lake), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert layer(spark, lake, "gold").count() == 10
    # a batch that the stream hands over once more
    batch = spark.read.format("binaryFile").load(str(folder / "f1.csv"))
    jobs.watcher(spark, lake)(batch, 1)
    assert layer(spark, lake, "gold").count() == layer(spark, lake, "bronze").count() == 10


def test_ragged_rows_can_be_audited(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3,4,5\n6\n")
    rows = files.read_csv(spark, [str(tmp_path / "r.csv")], audit=True).orderBy("source_row_number").collect()
    assert [(r["a"], r["b"], r["_corrupt_record"]) for r in rows] == [("1", "2", None), ("3", "4", "3,4,5"), ("6", None, "6")]


def test_delimiters(spark):
    texts = ["a,b\n1,2\n", "a;b,c\n1;2\n", "a|b|c\n1|2|3", "a\tb", "plain", "", "x;y;z", "a,b\nc;d\ne;f", "n;m\r\n1,5;2\r\n3;4,5\r\n"]
    assert column(spark, files.delimiter, texts) == [",", ";", "|", "\t", ",", ",", ";", ",", ";"]


def test_numbers_without_one_sort(spark):
    rows = [(None if i % 50 == 0 else i % 37, i) for i in range(500)]
    got = M.numbered(spark.createDataFrame(rows, "k int, i int").repartition(5), ["k", "i"], ranges=7).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["k"], r["i"]) for r in sorted(got, key=lambda r: r["number"])] == want and sorted(r["number"] for r in got) == list(range(1, 501))
    assert M.numbered(spark.createDataFrame([], "k int"), ["k"]).count() == 0
    raw = M.bronze(spark.createDataFrame([("b", 1), ("a", 2)], "t string, i int"), "x", order=["t"]).orderBy("source_row_number").collect()
    assert [(r["source_row_number"], r["raw_content"]) for r in raw] == [(1, '{"t":"a","i":2}'), (2, '{"t":"b","i":1}')]


def test_upload(spark):
    rows = [(1, "f", i, d, t, "Ali", "r1", a, "debit", "PKR", h) for i, (d, t, a, h) in enumerate([("15/03/2024", "Rent 03001234567", 5.005, "h1"), ("15/03/2024", "Rent 03001234567", 5.005, "h1"), ("bad", "x", 1.0, "h1"), ("16/03/2024", "Fuel", 2.0, "h1"), ("17/03/2024", "Old file", 2.0, "h0")])]
    df = spark.createDataFrame(rows, "org_id int, file string, row_id int, raw_date string, description string, party_name string, reference string, amount double, direction string, currency string, sha256 string")
    fuel = tenants.upload_rows(df.where("row_id = 3").withColumn("txn_date", S.parse_date(F.col("raw_date"))))
    done, counts = tenants.upload(df, fuel, spark.createDataFrame([(1, "h0")], "org_id int, sha256 string"))
    got = {r["row_id"]: (r["status"], r["description"]) for r in done.collect()}
    assert got == {0: ("imported", "Rent [PHONE_1]"), 1: ("skipped", "Rent [PHONE_1]"), 2: ("failed", "x"), 3: ("skipped", "Fuel")}
    job = counts.first()
    assert (job["rows_total"], job["rows_imported"], job["rows_skipped"], job["rows_failed"], job["rows_with_pii"], job["pii_types_detected"]) == (4, 1, 2, 1, 2, ["ACCOUNT_NO", "PHONE"])


def test_workbook_and_queries(spark):
    lines = [["txn_date", "description", "amount", "amount"], ["2025-02-01", "Internet bill", -3500, 1], ["2025-02-05", "Cash sale", 12000, 2]]
    df = spark.createDataFrame([("f.xlsx", bytearray(book(lines))), ("old.xls", bytearray(b"no zip"))], "path string, content binary")
    assert workbook.rows(workbook.cells(df)).orderBy("source_row_number").first()["fields"]["amount_3"] == "1"
    got = [r["fields"]["amount"] for r in workbook.rows(workbook.cells(df)).orderBy("source_row_number").collect()]
    assert got == ["-3500", "12000"]
    assert tables.checked("SELECT 1") == "SELECT 1"
    seen = {}

    class Reader:
        def __getattr__(self, name):
            return lambda *args, **kwargs: seen.update({args[0]: args[1:]} if name in ("option", "format") else kwargs) or self

    class Session:
        read = Reader()

    tables.read_query(Session(), "jdbc:x:y", "SELECT a FROM t;", user="u")
    assert seen["query"] == ("SELECT a FROM t",) and seen["url"] == ("jdbc:x:y",) and seen["user"] == "u" and "jdbc" in seen
    tables.read_table(Session(), "jdbc:x:y", "t", limit=5, partition=("id", 0, 100, 4))
    assert [seen[k] for k in ("dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")] == [("t",), ("id",), (0,), (100,), (4,)]
    with pytest.raises(ValueError, match="SELECT"):
        tables.read_query(Session(), "jdbc:x:y", "DELETE FROM t")
    for bad in ("DROP TABLE x", "WITH a AS (SELECT 1) DELETE FROM x", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            tables.checked(bad)


def test_stream(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.csv").write_text("Date,Amount\n")
    (folder / ".b.csv").write_text("x")
    (folder / "c.tmp").write_text("x")
    for _ in range(2):
        watch.run(watch.arrivals(spark, str(folder)), lambda df, i: seen.extend(r["path"] for r in df.select("path").collect()), str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert [p.rsplit("/", 1)[1] for p in seen] == ["a.csv"]
    events = spark.createDataFrame([(i, "k", dt.datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate([0, 1, 2, 3, 10])], "event_id int, key string, ts timestamp")
    assert sorted(r["event_id"] for r in watch.debounced(events, ["key"]).collect()) == [0, 2, 4]
    sinks.replace_partitions(events.select("event_id", "key"), str(tmp_path / "t"), ["key"])
    sinks.replace_partitions(events.select("event_id", "key").where("event_id = 1"), str(tmp_path / "t"), ["key"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.audit(spark, str(tmp_path / "audit"), [("op", "gold", "b", "ok", 1, None, 5)])
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1


def test_debounce_follows_the_rule(spark, tmp_path):
    rng = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]), base + dt.timedelta(milliseconds=rng.randrange(0, 400_000, 250))) for i in range(600)] + [(900, "a", None)]
    want, last = set(), {}
    for i, k, at in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        if k not in last or (at - last[k]).total_seconds() >= 2:
            want.add(i)
            last[k] = at
    events = spark.createDataFrame(rows, "event_id int, key string, ts timestamp").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r["event_id"] for r in watch.debounced(events, ["key"]).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_debounce_on_a_stream(spark, tmp_path):
    base, kept = dt.datetime(2024, 1, 1), []
    source, schema = str(tmp_path / "events"), "event_id int, key string, ts timestamp"
    for batch in ([(1, 0), (2, 1), (3, 3)], [(4, 4), (5, 5.5), (6, 20)]):
        rows = [(i, k, base + dt.timedelta(seconds=s)) for i, s in batch for k in ("a", "b")]
        spark.createDataFrame(rows[::-1], schema).coalesce(1).write.mode("append").parquet(source)
        stream = watch.debounced_stream(spark.readStream.schema(schema).parquet(source), "key")
        writer = stream.writeStream.foreachBatch(lambda df, i: kept.extend((r["key"], r["event_id"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck"))
        writer.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(kept) == [(k, i) for k in ("a", "b") for i in (1, 3, 5, 6)]


def test_encryption(spark):
    df = spark.createDataFrame([("secret", 1)], "v string, org int")
    sealed = S.encrypted(F.col("v"), "s", F.col("org"))
    assert df.select(S.decrypted(sealed, "s", F.col("org"))).first()[0] == "secret"


def test_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 70
