from cairn.llm import spam_pages as S

PROSE = "The transmitter of the station was replaced in 1987 because the modulator had failed twice during the winter trials. Operators noticed that the resolution of the display is better when the feed horn has been aligned. "
ZH = "更换发射机之后，试验人员没有再看到热漂移。虽然操作员预计会出现接收机饱和，但收发开关工作正常。后期型号用新的控制柜取代了原来的旋转关节。"
LINKS = "\n".join(f"[How a radome is built](http://shop{i}.example/item/{i})" for i in range(30))
TAGS = " ".join(f"#radar{i % 4} #sale #antenna" for i in range(40))
KEYS = "cheap radar kit buy radar best radar deals radar shop used radar radar price " * 12
MENU = "\n".join(f"SKU{i} | where to buy chart plotter | add to cart" for i in range(25))
STUFFED = "When you need marine radar, only marine radar is marine radar. Get marine radar today, marine radar now, marine radar always! " * 6
NAMES = ", ".join(f"Veltor AAA-{100 + i} radar price" for i in range(60))
SHEET = "\n".join(f"peak power {i}: {i * 7} kW" for i in range(30))
LOG = "\n".join(f"2024-05-{i:02d} 10:00 WARN The display of the station was switched to standby after the trial." for i in range(1, 29))
GLOSS = "\n".join(f"term{i} — The part of the receiver that keeps the echo of the target in the picture {i}." for i in range(20))
STEPS = "\n".join(f"{i}. Remove the bolts of cover {i} and lift the modulator out of the cabinet." for i in range(1, 20))
REFS = PROSE + "\nReferences:\n" + "\n".join(f"http://a.example/{i}" for i in range(10))
SPAM = [LINKS, TAGS, KEYS, MENU, STUFFED, NAMES, "雷达价格 雷达维修 " * 40, PROSE + "\n" + LINKS]
FINE = [PROSE * 3, ZH * 3, SHEET, LOG, GLOSS, STEPS, REFS, PROSE * 20 + "\n" + LINKS[:300], None, "", "  \n", "The modul", "M", "9A3F" * 200, ZH * 3 + "\n标签：雷达, 天线"]


def test_cases(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(SPAM + FINE)] + [(100 + i, PROSE + f" Number {i} was tested at the station with a new display and it was found to be good.", "x", 0) for i in range(40)] + [(None, KEYS, "x", 0)]
    rows += [(200 + i, ZH + f"第{i}台设备在测量船上的测试表明，稳定性主要取决于发射机。", "x", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    got = {r.doc_id for r in S.found(docs).collect()}
    assert got == set(range(len(SPAM))), (got ^ set(range(len(SPAM))))


def test_equal_texts_are_judged_alike_and_empty(spark):
    docs = spark.createDataFrame([(1, KEYS), (2, KEYS), (2, KEYS)], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.found(docs).collect()) == [1, 2]
    assert S.found(docs.limit(0)).count() == 0


def test_short_lists_and_other_languages(spark):
    """A page of three entries is a list whatever its length, one or two are not; other languages are judged by their own words."""
    french = "Le radar de la station est remplacé par un modèle plus récent et les essais sont terminés dans le port. Il est installé sur le mât et les opérateurs ont noté une portée qui est plus grande. " * 3
    russian = "Передатчик станции был заменён после испытаний, потому что модулятор отказал дважды. Операторы заметили, что разрешение стало лучше. " * 3
    cases = [("home | shop | cart", True), ("radar kit, radar set, radar box", True), ("Veltor AAA-100", False), ("Receiver\nDisplay", False), (french, False), (russian, False), ("http://a.example/b", True)]
    rows = [(i, t) for i, (t, _) in enumerate(cases)] + [(100 + i, PROSE + f" Number {i} was tested.") for i in range(30)]
    got = {r.doc_id for r in S.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, (_, spam) in enumerate(cases) if spam}


def test_links_by_density_not_by_length(spark):
    few = PROSE * 2 + "[see the maker](http://a.example/1) "
    line = " ".join(f"[How a rather good radome of the station is built from several layers of glass {i}](http://s.example/{i})" for i in range(12))
    got = {r.doc_id for r in S.found(spark.createDataFrame([(1, few), (2, line)], "doc_id long, text string")).collect()}
    assert got == {2}
