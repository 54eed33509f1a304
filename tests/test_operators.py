import random

from pyspark.sql import functions as F

from veilspark.functions.values import keep_head
from veilspark.operators import candidates as C
from veilspark.operators import addresses, decode, names, organisations, realistic, rewrite, tiles, tolerant
from veilspark.operators.gazetteer import Gazetteer

TEXT = (
    "王先生 生日：民國78年5月12日，手機 0912-118-406、+886 935 221 087，市話 (02)2345-6789#205，"
    "Email chen.yuting@gmail.com，IG https://www.instagram.com/yuting_daily/。LINE ID：@metro_chen88，密碼 Ab#29xQ!77，車牌 BKR-5821，"
    "住 114066 臺北市內湖區瑞光路999巷88號7樓，醫字第098765號，金額 3,500 元，2023/11/25 就診，10/27 出貨，一一二年五月十日。"
)


def test_structured_candidates(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id int, text string")
    got = {(r["value"], r["kind"]) for r in C.structured(df).collect()}
    for want in [("民國78年5月12日", "date"), ("78年5月12日", "date"), ("chen.yuting@gmail.com", "email"), ("https://www.instagram.com/yuting_daily/", "url"), ("@metro_chen88", "alnum"), ("metro_chen88", "alnum"), ("Ab#29xQ!77", "alnum"), ("BKR-5821", "alnum"), ("醫字第098765號", "zi"), ("2023/11/25", "date"), ("10/27", "date"), ("一一二年五月十日", "date")]:
        assert want in got, want
    for r in C.structured(df).collect():
        assert TEXT[r["start"] : r["end"]] == r["value"]


def found(spark, text, column):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = df.select(column.alias("x")).first()["x"]
    assert all(text[r["start"] : r["end"]] == r["value"] for r in rows)
    return {(r["value"], r["kind"]) for r in rows}


def test_number_chains(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id int, text string")
    got = {TEXT[r["start"] : r["end"]] for r in C.number_chains(df).collect()}
    assert {"0912-118-406", "+886 935 221 087", "(02)2345-6789#205", "(02)2345-6789", "02)2345-6789", "118-406"} <= got
    assert "3,500" not in got and "500" not in got
    odd = "密碼1805#，證號 G 1 3 7 9 0 2，12.345 與 1,234,567 及 分機轉 22-33 轉 7 ok 1 2"
    got = {odd[r["start"] : r["end"]] for r in C.number_chains(spark.createDataFrame([(1, odd)], "doc_id int, text string")).collect()}
    assert {"1805#", "1805", "G 1 3 7 9 0 2", "1 3 7 9 0 2", "22-33", "22-33 轉 7"} <= got and not any("345" in x or "567" in x for x in got) and "1 2" not in got


def test_structured_of_damaged_text(spark):
    damaged = "電話 O912-１１8^\n4O6，生日民國 78 年 5 月 l2 曰"
    got = {r["value"] for r in C.structured(spark.createDataFrame([(1, damaged)], "doc_id int, text string")).collect()}
    assert {"O912-１１8^\n4O6", "民國 78 年 5 月 l2 曰"} <= got
    assert C.structured(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")).count() == 0


def test_names(spark):
    text = "我姓張，林小姐與王 小 明、歐陽修到場，Hi 雅婷，阿志說，老王。瓦歷斯·諾幹與 Mary Smith、CINDY林"
    got = found(spark, text, names.persons(F.col("text")))
    want = [("張", "partial"), ("林", "partial"), ("王 小 明", "full"), ("歐陽修", "full"), ("雅婷", "given"), ("阿志", "nick"), ("老王", "nick"), ("瓦歷斯·諾幹", "translit"), ("斯·諾", "translit"), ("Mary Smith", "latin"), ("CINDY林", "latin")]
    assert set(want) <= got, set(want) - got
    kana = Gazetteer(kana_surnames=frozenset({"久保田"}))
    assert ("久保田ゆかり", "full") in found(spark, "久保田ゆかり來", names.persons(F.col("text"), kana))
    docs = spark.createDataFrame([(1, "王小明說，小明來")], "doc_id int, text string")
    masked = spark.createDataFrame([(1, "王小明")], "doc_id int, value string")
    assert sorted((r["start"], r["value"]) for r in names.given_mentions(docs, masked).collect()) == [(1, "小明"), (5, "小明")]


def test_addresses(spark):
    got = {v for v, _ in found(spark, TEXT, addresses.addresses(F.col("text")))}
    assert {"114066 臺北市內湖區瑞光路999巷88號7樓", "臺北市內湖區瑞光路999巷88號", "瑞光路999巷88號"} <= got
    damaged = "居住所： 臺南市永康區大； ^灣 里 7鄰大勇路二段 2 5號4樓\n"
    assert "臺南市永康區大； ^灣 里 7鄰大勇路二段 2 5號4樓" in {v for v, _ in found(spark, damaged, tolerant.scanned(F.col("text"), addresses.addresses))}
    for t in ("安區瑞光路99號", "大安區瑞光路99號", "區瑞光路99號", "", "新店區碧潭段123-4地號"):
        found(spark, t, addresses.addresses(F.col("text")))
    listed = Gazetteer(roads=frozenset({"府前一村新生路"}), districts=frozenset({"中西區"}))
    assert "臺南市中西區府前一村新生路 5號" in {v for v, _ in found(spark, "住臺南市中西區府前一村新生路 5號", addresses.addresses(F.col("text"), listed))}


def test_organisations(spark):
    text = "由澄嶼顧問股份有限公司與Acme Trading Co., Ltd. 承作，被告澄嶼表示「安心」方案，大里郵局，7-11 台中門市，依公司法，農產行負責人，Orion Fitness"
    got = found(spark, text, organisations.organisations(F.col("text")))
    want = [("澄嶼顧問股份有限公司", "org"), ("澄嶼", "org_stem"), ("Acme Trading Co., Ltd.", "org_en"), ("安心", "org_q"), ("大里郵局", "org"), ("7-11 台中門市", "org"), ("7-11", "org"), ("農產行", "org"), ("Orion Fitness", "org_en")]
    assert set(want) <= got, set(want) - got
    assert not any(v.endswith("依公司") for v, _ in got)
    g = Gazetteer(companies=frozenset({"台積電", "中華"}))
    got = found(spark, "被告台積電與中華", organisations.organisations(F.col("text"), g))
    assert ("台積電", "org") in got and ("中華", "org") not in got


def test_clean_text_keeps_places(spark):
    text = "電話 O912-１１8 4O6^\n5，王 小明 A~B"
    r = spark.createDataFrame([(1, text)], "doc_id int, text string").select(tolerant.clean_text(F.col("text")).alias("c"), tolerant.places(F.col("text")).alias("p")).first()
    assert len(r["c"]) == len(r["p"]) and r["p"] == sorted(r["p"]) and "0912-1184065" in r["c"] and "王小明" in r["c"]
    assert all(text[p] == c for c, p in zip(r["c"], r["p"], strict=True) if not c.isdigit())


def walk(n, keep):
    """Tiles one after the other, as a test of the fold."""
    keep = [(s, e) for s, e in keep if 60 < e - s <= 220]
    out, s = [], 0
    while True:
        e = min(n, s + 220)
        if e < n:
            e = min([e] + [a + 60 for a, b in keep if s < a and a + 60 < e < b])
        out.append((s, e, s + 30 if s else 0, e if e == n else e - 30))
        if e == n:
            return out
        s = e - 60


def test_tiles_keep_long_values(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        n = rng.randrange(0, 1500)
        rows.append((i, "x" * n, sorted((s, min(n, s + rng.randrange(20, 260))) for s in (rng.randrange(0, max(n, 1)) for _ in range(rng.randrange(0, 6))))))
    df = spark.createDataFrame(rows, "doc_id int, text string, keep array<struct<start:int,end:int>>")
    got = {}
    for r in tiles.tiles_keeping(df, F.col("keep")).orderBy("doc_id", "ws").collect():
        got.setdefault(r["doc_id"], []).append((r["ws"], r["we"], r["core_s"], r["core_e"]))
    assert got == {i: walk(len(t), keep) for i, t, keep in rows}


def test_tile_array_is_the_walk(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 220, 221, 380, 381, 1000)], "doc_id int, text string")
    got = {}
    for r in tiles.tiles(df).orderBy("ws").collect():
        got.setdefault(r["doc_id"], []).append((r["ws"], r["we"], r["core_s"], r["core_e"]))
    assert got == {n: walk(n, []) for n in (0, 1, 220, 221, 380, 381, 1000)}


def greedy(rows, tau):
    chosen = []
    for s, e, kind, pm, pk in sorted(rows, key=lambda r: (-(r[3] + r[4]), r[0], r[1], r[2])):
        if pm + pk >= tau and not any(a < e and s < b for a, b in chosen):
            chosen.append((s, e))
    return sorted(chosen)


def test_selection_is_greedy(spark):
    rng = random.Random(5)
    rows = [(d, s, s + rng.randrange(1, 9), rng.choice(["full", "date", "org", "num"]), rng.random() / 2, rng.random() / 2) for d in range(20) for s in [rng.randrange(60) for _ in range(25)]]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, kind string, p_mask double, p_keep double")
    got = {}
    for r in decode.selected(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {d: greedy([r[1:] for r in rows if r[0] == d], 0.5) for d in range(20)}


def test_long_values_replace_their_pieces(spark):
    spans = spark.createDataFrame([(1, 250, 283, "URL", 0.9, 0.9, "url"), (1, 300, 310, "PERSON", 0.8, 0.8, "full"), (2, 0, 5, "PERSON", 0.7, 0.7, "full")], "doc_id int, start int, end int, type string, score double, p_mask double, kind string")
    values = spark.createDataFrame([(1, 0, 283, "URL")], "doc_id int, start int, end int, type string")
    got = {(r["doc_id"], r["start"], r["end"], r["type"]) for r in decode.extend_long(spans, values, 220).collect()}
    assert got == {(1, 0, 283, "URL"), (1, 300, 310, "PERSON"), (2, 0, 5, "PERSON")}


def test_rewriting_restores(spark):
    docs = spark.createDataFrame([(1, "𡍼王 a b c"), (2, None), (3, "")], "doc_id int, text string")
    r = spark.createDataFrame([(1, 0, 2, "甲甲甲"), (1, 5, 6, "")], "doc_id int, start int, end int, new string")
    out = rewrite.rewritten(docs, r)
    back = {x["doc_id"]: (x["rewritten"], x["b"]) for x in out.withColumn("b", decode.restored(F.col("rewritten"), F.col("log"))).collect()}
    assert back[1] == ("甲甲甲 a  c", "𡍼王 a b c") and back[3] == ("", "")


def test_overlaps_longest_first(spark):
    df = spark.createDataFrame([([(0, 3), (0, 5), (4, 8), (5, 6)],)], "h array<struct<start:int,end:int>>")
    assert [tuple(x) for x in df.select(decode.longest_first(F.col("h")).alias("o")).first()["o"]] == [(0, 5), (5, 6)]


def test_pseudonyms_keep_one_value(spark):
    df = spark.createDataFrame([(1, 7, "0912-345-678"), (2, 7, "0912-345-678"), (3, 8, "0912-345-678")], "doc_id int, case_id int, value string")
    got = [r["new"] for r in realistic.pseudonyms(df, ["case_id"], "s", keep_head(F.col("value"))).orderBy("doc_id").collect()]
    assert got[0] == got[1] != got[2] and all(x.startswith("09") and len(x) == 12 for x in got)


def test_selection_and_splice_of_long_documents(spark):
    """A document of 100,000 characters with thousands of candidates: islands and pieces, no quadratic folds."""
    n = 20_000
    df = spark.range(n).selectExpr("1 as doc_id", "cast(id * 5 as int) as start", "cast(id * 5 + 3 + id % 3 as int) as end", "'num' as kind", "0.5 + (id % 7) / 100.0 as p_mask", "0.1D as p_keep").withColumn("p_mask", F.col("p_mask").cast("double"))
    chosen = decode.selected(df)
    rows = sorted((r["start"], r["end"]) for r in chosen.collect())
    assert len(rows) > n // 2 and all(a[1] <= b[0] for a, b in zip(rows, rows[1:], strict=False))
    docs = spark.createDataFrame([(1, "0123456789" * 10_001)], "doc_id int, text string")
    out = rewrite.rewritten(docs, chosen.select("doc_id", "start", "end", F.lit("〔號碼〕").alias("new"))).withColumn("back", decode.restored(F.col("rewritten"), F.col("log"))).first()
    assert out["back"] == out["text"] and out["rewritten"].count("〔號碼〕") == len(rows)


def test_realistic_names(spark):
    people = [(1, "陳大文", "full"), (1, "陳", "partial"), (1, "大文", "given"), (1, "林美", "full"), (1, "阿文", "nick"), (1, "老陳", "nick"), (1, "Mary Smith", "latin"), (2, "陳大文", "full"), (1, "無", "given")]
    df = spark.createDataFrame(people, "case_id int, value string, kind string")
    got = {(r["case_id"], r["value"]): r["new"] for r in realistic.persons(df, ["case_id"], "s").collect()}
    full = got[1, "陳大文"]
    assert full[0] == got[1, "陳"] == got[1, "老陳"][1] and full[1:] == got[1, "大文"] and full[2] == got[1, "阿文"][1] and got[1, "老陳"][0] == "老"
    assert got[1, "林美"][0] != full[0] and all(v != k[1] and len(v) == len(k[1]) or " " in v for k, v in got.items()) and got[1, "Mary Smith"].count(" ") == 1
    many = spark.createDataFrame([(1, c) for c in "陳林黃張李王吳劉蔡楊許鄭謝洪郭邱曾廖賴徐周葉蘇莊江呂何蕭羅高潘簡朱鍾游彭詹施胡沈"], "case_id int, surname string")
    fakes = [(r["surname"], r["fake"]) for r in realistic.surname_map(many, ["case_id"], "s").collect()]
    assert len({f for _, f in fakes}) == 40 and all(a != b for a, b in fakes)


def test_codes_of_parts_and_templates(spark):
    rows = [(1, 0, "陳大文", "full"), (1, 5, "陳", "partial"), (1, 9, "大文", "given"), (1, 12, "林一", "full"), (1, 15, "林二", "full"), (1, 18, "林", "partial"), (1, 20, "阿珠", "nick"), (1, 25, "陳大文", "full")]
    spans = spark.createDataFrame([(*r, "PERSON") for r in rows], "doc_id int, start int, value string, kind string, type string")
    got = {r["start"]: r["new"] for r in rewrite.coded(spans, ["doc_id"], ["start"]).collect()}
    assert got == {0: "甲", 5: "甲", 9: "甲", 12: "乙", 15: "丙", 18: "〇", 20: "丁", 25: "甲"}
    used = rewrite.reserved(spark.createDataFrame([(1, "甲、〔電話1〕，A 公司")], "doc_id int, text string"), ["doc_id"])
    more = [(1, 0, "陳大文", "full", "PERSON"), (1, 5, "澄嶼顧問股份有限公司", "org", "ORG"), (1, 20, "0912-345-678", "num", "NUMBER"), (1, 40, "臺北市內湖區瑞光路99號", "addr", "ADDRESS"), (1, 60, "永康段123-4地號", "addr", "ADDRESS"), (1, 80, "民國78年5月12日", "date", "DATE"), (1, 99, "Acme", "org_en", "ORG")]
    got = {r["start"]: r["new"] for r in rewrite.coded(spark.createDataFrame(more, "doc_id int, start int, value string, kind string, type string"), ["doc_id"], ["start"], used=used).collect()}
    assert got == {0: "乙", 5: "B顧問股份有限公司", 20: "〔電話2〕", 40: "臺北市〔地址1〕", 60: "永康段〔地號1〕", 80: "民國78年", 99: "Company C"}


def test_restores_what_replies_write(spark):
    table = spark.createDataFrame(
        [(1, "甲", "陳大文", "PERSON", False), (1, "〔電話1〕", "0912-345-678", "NUMBER", False), (1, "劉", "陳", "SURNAME", False), (1, "0988-111-222", "0912-000-111", "NUMBER", False), (1, "民國80年3月2日", "民國78年5月12日", "DATE", False), (1, "〇", "林一", "PERSON", True)],
        "case_id int, fake string, original string, type string, ambiguous boolean",
    )
    replies = [("甲未到庭，甲方、指甲不動", "陳大文未到庭，甲方、指甲不動"), ("撥[電話1]或【電話 1】", "撥0912-345-678或0912-345-678"), ("劉先生說，我姓劉，劉取車", "陳先生說，我姓陳，劉取車"), ("0988111222", "0912-000-111"), ("1991年3月2日", "1991年3月2日"), ("80/03/02 到", "民國78年5月12日 到"), ("〇不動", "〇不動"), ("", "")]
    df = spark.createDataFrame([(1, i, t) for i, (t, _) in enumerate(replies)], "case_id int, reply_id int, text string")
    got = {r["reply_id"]: r["restored"] for r in rewrite.restored_by_mapping(df, table, ["case_id"]).collect()}
    assert got == {i: w for i, (_, w) in enumerate(replies)}


def test_guard_marks_what_would_go_wrong(spark):
    docs = spark.createDataFrame([(1, "王小明與甲來")], "doc_id int, text string")
    new = spark.createDataFrame([(1, 0, 3, "甲", "王小明", "PERSON")], "doc_id int, start int, end int, new string, value string, type string")
    out = rewrite.rewritten(docs, new)
    table = rewrite.guarded(out, rewrite.mapping(new, ["doc_id"]), ["doc_id"])
    assert [(r["fake"], r["ambiguous"]) for r in table.collect()] == [("甲", True)]
