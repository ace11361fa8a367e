import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import encoding as E
from factloom.llm import lookalikes as L
from factloom.llm import packing as P
from factloom.llm import residue as R
from factloom.llm import tokens as T


# --- tokens ---------------------------------------------------------------------------------------------------


def test_streaming_equals_whole(monkeypatch):
    vocab = T.vocabulary()
    random.seed(1)
    parts = ["a", "ab ", "é", "the ", " ", "  ", "\n", "'ll", "'", "1", "世", "!", "-", "x" * 50, "　", "\x1c", "\x85"]
    for _ in range(1500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 60)))
        monkeypatch.setattr(T, "CHUNK", random.choice([8, 16, 23, 40]))
        ids = list(T.encode_stream([text[i : i + 7] for i in range(0, len(text), 7)], vocab))
        assert ids == vocab.encoding.encode_ordinary(text) and T.decode(ids, vocab) == text


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 150_000 + "x", "é" * 100_000, "=" * 150_000 + "!", " " + "z" * 90_000 + " \n" * 60_000 + "q"])
def test_one_giant_word(text):
    vocab = T.vocabulary()
    assert T.encode(text, vocab) == vocab.encoding.encode_ordinary(text)


def test_lookahead_is_sufficient():
    vocab = T.vocabulary()
    random.seed(2)
    assert 0 < vocab.lookahead < 1000
    for alphabet in ("etaoinshr", "ab", "=-", "0123", "é世"):
        for _ in range(100):
            data = "".join(random.choice(alphabet) for _ in range(random.randint(0, 1500))).encode()
            piece = T.PieceTransducer(vocab, 1)
            piece.window = vocab.lookahead + vocab.longest + random.randint(0, 60)
            ids = [i for at in range(0, len(data), 97) for i in piece.feed(data[at : at + 97])] + list(piece.close())
            assert ids == vocab.piece(data)


def test_small_merge_list_lookahead():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    assert T.split_pair(b"abc", ranks) == (b"ab", b"c") and T.sufficient_lookahead(ranks) == 1


def test_ids_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "Hello world")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in T.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {1: [], 2: [], 3: [220], 4: [15496, 995]}
    back = spark.createDataFrame([([15496, 995],), ([],), (None,)], "i array<int>").select(T.decoded(F.col("i")).alias("t")).collect()
    assert [r.t for r in back] == ["Hello world", "", None]


# --- packing --------------------------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    packer = P.BestFit(10, open_bins=2)
    closed = [c for item, size in (("a", 6), ("b", 5), ("c", 5), ("d", 4)) for c in packer.add(item, size)]
    assert closed == [(["b", "c"], 0), (["a", "d"], 0)]
    packer = P.BestFit(10, open_bins=2)
    closed = [c for item, size in (("a", 8), ("b", 7), ("c", 6)) for c in packer.add(item, size)]
    assert closed == [(["a"], 2)] and sorted(packer.close(), key=str) == [(["b"], 3), (["c"], 4)]


def test_nothing_is_lost_split_or_overfull(spark, tmp_path):
    random.seed(5)
    sizes = [(i, random.choice([0, 1, 3, 7, 10, 11, 25, 90, None])) for i in range(700)] + [(None, 4), (3, 3)]
    items = spark.createDataFrame(sizes, "id long, size long").repartition(5)
    rows = P.pack(spark, items, {1: 10, 2: 30}, f"file://{tmp_path}/a", open_bins=4).collect()
    for capacity_id, capacity in ((1, 10), (2, 30)):
        mine = [r for r in rows if r.capacity_id == capacity_id]
        fill, whole = {}, {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.size
            whole.setdefault(r.id, []).append((r.piece, r.start, r.size))
        assert max(fill.values()) <= capacity
        assert sum(fill.values()) == sum(s or 0 for _, s in sizes)
        for i, s in sizes:
            if i not in (3, None):
                assert sorted(whole[i]) == list(P.pieces(s or 0, capacity))
                assert len(whole[i]) == 1 or s > capacity
        assert len(fill) <= -(-sum(fill.values()) // capacity) * 1.1 + 2


def test_pack_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, size long")
    assert P.pack(spark, empty, {1: 10}, f"file://{tmp_path}/b").count() == 0 and P.pack(spark, empty, {}, f"file://{tmp_path}/c").count() == 0


# --- look-alikes ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def spelling(spark):
    return L.Spelling(L.confusables(spark))


@pytest.mark.parametrize("a, b", [
    ("Рoѕtmаn", "Postman"), ("Ｔｈｅ　Ｅｎｄ", "The End"), ("Café", "Café"), ("Pa​per Fer­ry", "Paper Ferry"), ("Ⅽlub", "Club"), ("Нoчнoй", "Ночной"),
    ("Тο Σπίτι", "Το Σπίτι"), ("Half‐Hour", "Half-Hour"), ("ﬁn", "fin"), ("Ѕеа", "Sea"), ("﻿A", "A"), ("Ｋ", "K"),
])
def test_same_look_same_form(spelling, a, b):
    assert spelling.of(a) == spelling.of(b)


@pytest.mark.parametrize("a, b", [("Cafe", "Café"), ("Paper", "paper"), ("PaperFerry", "Paper Ferry"), ("Il", "ll"), ("O", "0"), ("x²", "x2"), ("A!", "A"), ("rn", "m"), ("Half—Hour", "Half-Hour")])
def test_other_look_other_form(spelling, a, b):
    assert spelling.of(a) != spelling.of(b)


def test_forms_are_stable_and_ascii_is_itself(spelling):
    ascii_text = "".join(map(chr, range(32, 127)))
    assert spelling.of(ascii_text) == ascii_text and spelling._token(ascii_text.replace(" ", "")) == ascii_text.replace(" ", "")
    assert spelling.of(None) is None and spelling.of("") == ""
    for text in ("Ночной Архив", "Žetva kod Šestog", "遠い灯台", "Το Σπίτι", "Đurđica"):
        assert spelling.of(spelling.of(text)) == spelling.of(text)


@pytest.mark.parametrize("a, b", [("力メラ", "カメラ"), ("口ボット", "ロボット"), ("工ース", "エース"), ("二ュース", "ニュース"), ("夕ワー", "タワー"), ("ハー卜", "ハート"), ("八ート", "ハート"), ("カの灯台", "力の灯台")])
def test_ideographs_look_like_kana(spelling, a, b):
    assert spelling.of(a) == spelling.of(b) and spelling.of("ハート") == "ハート" and spelling.of("灯台") != spelling.of("灯合")


@pytest.mark.parametrize("text", ["Το Νησί χωρίς Φως", "Η Γέφυρα", "Đurđica", "Сосна в расе", "Τα Νέα", "Море", "力の灯台", "最終シーズン", "Åse's Café"])
def test_clean_names_stay(spelling, text):
    assert spelling.told(text) == (text, None)


@pytest.mark.parametrize("text, form, confusion", [
    ("Pаper Ferry", "Paper Ferry", "mixed"), ("Ѕеа", "Sea", "whole"), ("The Ѕеа", "The Sea", "whole"), ("Ｆｕｌｌ", "Full", "form"), ("Pa\u200bper", "Paper", "form"), ("Сосна в pace", "Сосна в расе", "whole"),
])
def test_kinds_of_confusion(spelling, text, form, confusion):
    assert spelling.told(text) == (form, confusion) and spelling.key(text) == spelling.key(form)


def test_keys_tell_look_alikes_of_one_script(spelling):
    assert spelling.key("Đurđica") == spelling.key("Ðurđica") and spelling.key("Cafe") != spelling.key("Café")


@pytest.mark.parametrize("text, key", [("Сосна и кедр", "Сосна и кедр"), ("Нoчнoй", "Ночной"), ("Рoѕtmаn", "Postman"), ("Ѕеа", "Sea"), ("Το Νησί χωρίς Φως", "To Νηοί χωρίς Φως"), ("ꓑаper", "Paper"), ("“A1”|'", "“A1”|'")])
def test_keys_are_written_token_by_token_in_one_script(spelling, text, key):
    assert spelling.key(text) == key and spelling.key(key) == key


@pytest.mark.parametrize("text, name, difference", [
    ("Pаper Ferry", "Paper Ferry", "mixed"), ("The Ѕеа", "The Sea", "whole"), ("Ðurđica", "Đurđica", "single"), ("Ｆｕｌｌ", "Full", "form"), ("Half‐Hour", "Half-Hour", "form"), ("расе", "pace", "whole"),
    ("ꓑаper", "Paper", "mixed"), ("ꓑꓳꓲ", "POl", "whole"), ("Sea", "Sea", None), ("Sea", "SEA", None), ("Seas", "Sea", None), ("The Sea", "Sea", None),
])
def test_differences_from_a_name(spelling, text, name, difference):
    assert spelling.difference(text, name) == difference and (spelling.key(text) == spelling.key(name)) == (difference is not None or text == name)


def test_a_long_token_takes_linear_time(spelling):
    text = "Сосна" * 100_000
    assert spelling.key(text) == text and spelling.difference(text + "\u200b", text) == "form" and spelling._tokens("a-bé 1́x!") == ["a", "-", "bé", " ", "1́x", "!"]


def test_mixed_and_whole_tokens_are_told_apart_where_names_are_found(spark):
    names = spark.createDataFrame([(1, "Paper Ferry"), (1, "Рарег Ferry"), (2, "расе"), (3, "Paper")], "key int, name string")
    rows = [(1, "Pаper Ferry"), (1, "Paper\u00a0Ferry"), (2, "pace"), (3, "ꓑaper"), (3, "Рарer"), (3, "Раper!")]
    found = L.names_that_look(spark, spark.createDataFrame(rows, "key int, text string"), names).select("text", "form", "confusion")
    assert sorted(map(tuple, found.collect())) == sorted([
        ("Pаper Ferry", "Paper Ferry", "mixed"), ("Paper\u00a0Ferry", "Paper Ferry", "form"), ("pace", "pace", "whole"), ("ꓑaper", "Paper", "mixed"), ("Рарer", "Paper", "mixed"),
    ])


def test_names_are_joined_either_way(spark, monkeypatch):
    names = spark.createDataFrame([(1, "Paper Ferry"), (2, "Sea")], "key int, name string")
    occurrences = spark.createDataFrame([(1, "Pаper Ferry"), (2, "Sеa"), (2, "Sea"), (3, "x")], "key int, text string")
    few = sorted(map(tuple, L.names_that_look(spark, occurrences, names).collect()))
    monkeypatch.setattr(L, "FEW_NAMES", 1)
    assert few == sorted(map(tuple, L.names_that_look(spark, occurrences, names).collect())) and len(few) == 2


def test_names_that_look(spark):
    names = spark.createDataFrame([(1, "Paper Ferry"), (1, "Café"), (2, "Sea"), (3, None)], "key int, name string")
    rows = [(1, "Paper Ferry", "n"), (1, "Pаper Ferry", "y"), (1, "Pаper Ferry", "y"), (2, "Paper Ferry", "other key"), (None, "Sеa", "null key"), (2, None, "null text"), (2, "Sеa", "y"), (1, "PAPER FERRY", "case"), (9, "Sea", "no names")]
    occurrences = spark.createDataFrame(rows, "key int, text string, salt string")
    assert sorted(r.text for r in L.names_that_look(spark, occurrences.withColumn("names", F.lit("clash")), names).collect()) == sorted(["Pаper Ferry"] * 2 + ["Sеa"])


# --- encodings ------------------------------------------------------------------------------------------------

CLEAN = [
    "La temporada empezó en España y Perú, según informó la compañía", "Más suspense y menos diálogo: así será el capítulo", "A série não voltará antes do verão, diz a direção",
    "Nächste Staffel für Käthe beginnt – große Enttäuschung", "Sljedeća sezona stiže u ožujku, a gledatelji će čekati još šest tjedana", "Новый сезон сериала выйдет весной",
    "Съёмки сезона уже начались", "« La cinquième saison a été confirmée » – déjà prévue", "最終シーズンは来年春に配信予定", "It’s official – “The End” won’t be back…", "NÃO DISPONÍVEL ATÉ AMANHÃ", "Åse's Café®",
]


@pytest.fixture(scope="module")
def chains():
    import numpy as np

    table = np.zeros(E.SIZE, dtype=np.int64)
    E.count_into(table, CLEAN * 40)
    return E.Chains(table.astype(np.float32))


def broken(text, meant, wrong):
    table = E.byte_table(wrong)
    return "".join(chr(b) if b < 0x80 else table[b - 0x80] for b in text.encode(meant))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_right(chains, text):
    assert E.verdict(chains, E.MARGINS, text) is None


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman"])
@pytest.mark.parametrize("text", CLEAN[:5] + CLEAN[7:8])
def test_utf8_chains_are_restored(chains, text, wrong):
    assert E.verdict(chains, E.MARGINS, broken(text, "utf-8", wrong))[1] == text


def test_other_chains(chains):
    assert E.verdict(chains, E.MARGINS, broken(CLEAN[5], "koi8-r", "cp1251"))[1] == CLEAN[5]
    assert E.verdict(chains, E.MARGINS, broken(CLEAN[5], "cp1251", "cp1252"))[1] == CLEAN[5]
    twice = broken(broken(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert E.verdict(chains, E.MARGINS, twice)[1] == CLEAN[0]
    partly = CLEAN[0].replace("compañía", broken("compañía", "utf-8", "cp1252"))
    assert E.verdict(chains, E.MARGINS, partly)[1] == CLEAN[0]
    lost = "".join(c for c in broken(CLEAN[2], "utf-8", "latin-1") if not "\x80" <= c <= "\x9f")
    assert E.verdict(chains, E.MARGINS, lost) is None or E.verdict(chains, E.MARGINS, lost)[1] == CLEAN[2]
    assert E.verdict(chains, E.MARGINS, "A�n quedan") == ("lost", None)


@pytest.mark.parametrize("text, meant, wrong", [
    (CLEAN[4], "cp1250", "cp437"), (CLEAN[4], "cp1250", "cp1251"), (CLEAN[5], "cp1251", "cp1250"), (CLEAN[5], "cp1251", "mac-roman"), (CLEAN[5], "iso8859-5", "cp1253"),
    ("Šesta sezona stiže", "cp1250", "latin-1"), ("Η νέα σεζόν έρχεται", "cp1253", "cp1250"), ("Η νέα σεζόν έρχεται", "iso8859-7", "cp1252"),
    (CLEAN[0], "utf-16-le", "cp1252"), (CLEAN[5], "utf-16-be", "latin-1"), ("The End is back", "utf-16-le", "cp1252"),
])
def test_any_pair_of_encodings(text, meant, wrong):
    import numpy as np

    table = np.zeros(E.SIZE, dtype=np.int64)
    E.count_into(table, [*CLEAN, "Šesta sezona stiže", "Η νέα σεζόν έρχεται", "The End is back"] * 40)
    assert E.verdict(E.Chains(table.astype(np.float32)), E.MARGINS, broken(text, meant, wrong))[1] == text


def test_vietnamese_and_utf7():
    import numpy as np

    text, table = "Phần tiếp theo của loạt phim", np.zeros(E.SIZE, dtype=np.int64)
    E.count_into(table, [*CLEAN, text] * 40)
    chains = E.Chains(table.astype(np.float32))
    # Vietnamese bytes hold the tone apart from the letter.
    bytes_of = {"ầ": b"\xe2\xcc", "ế": b"\xea\xec", "ủ": b"u\xd2", "ạ": b"a\xf2"}
    raw = b"".join(bytes_of.get(c) or c.encode("cp1258") for c in text)
    assert E.verdict(chains, E.MARGINS, raw.decode("cp1252"))[1] == text
    assert E.verdict(chains, E.MARGINS, CLEAN[0].encode("utf-7").decode("ascii"))[1] == CLEAN[0]


def test_garbled_ascii_reaches_the_model_in_spark(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 20)] + [(1000, broken("Más suspense", "utf-16-le", "cp1252")), (1001, CLEAN[0].encode("utf-7").decode("ascii")), (1002, "ascii + more")]
    got = E.find_garbled(spark, spark.createDataFrame(rows, "id int, t string"), "t", ["id"]).collect()
    assert sorted(r.id for r in got) == [1000, 1001]


def test_hash_tables_agree():
    import numpy as np

    table = np.zeros(E.SIZE, dtype=np.int64)
    E.count_into(table, ["añ😀"])
    codes = [32, 32, *map(ord, "añ😀"), 32]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        assert table[E.hash3(a, b, c)] >= 1 and table[(1 << E.BITS3) + E.hash2(b, c)] >= 1


def test_find_garbled_in_spark(spark):
    rows = [(i, t, "x") for i, t in enumerate(CLEAN * 20)] + [(1000, broken(CLEAN[0], "utf-8", "cp1252"), "x"), (1001, None, "x"), (1002, "", "x"), (1003, "ascii", "x"), (1000, broken(CLEAN[0], "utf-8", "cp1252"), "x")]
    df = spark.createDataFrame(rows, "id int, t string, chain string").withColumnRenamed("chain", "tag")
    got = E.find_garbled(spark, df, "t", ["id"]).collect()
    assert sorted(r.id for r in got) == [1000, 1000] and got[0].restored == CLEAN[0]
    assert E.find_garbled(spark, df.limit(0), "t", ["id"]).count() == 0


def test_margins_come_from_distinct_texts_and_bear_hidden_damage(spark):
    import numpy as np

    table = np.zeros(E.SIZE, dtype=np.int64)
    E.count_into(table, CLEAN * 40)
    hidden = [broken(CLEAN[4], "cp1250", "cp1252"), broken(CLEAN[0], "utf-8", "cp1252")]
    held_out = spark.createDataFrame([(f"{t} {i}",) for i in range(20) for t in CLEAN] + [(f"{t} {i}",) for i in range(3) for t in hidden], "t string")
    limits = E.margins(spark, table.astype(np.float32), held_out)
    chains = E.Chains(table.astype(np.float32))
    assert all(E.verdict(chains, limits, t) is not None for t in hidden) and all(E.verdict(chains, limits, t) is None for t in CLEAN)


def test_one_text_does_not_fill_the_validation(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "margins", lambda *given: seen.append(given[-1].collect() if hasattr(given[-1], "collect") else given[-1]) or dict(E.MARGINS))
    texts = [f"{t} {i}" for i in range(100) for t in CLEAN]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    held_out = [r.t for r in df.where(F.pmod(F.xxhash64("t"), F.lit(E.HELD_OUT)) == 0).collect()]
    E.fit(spark, df.unionByName(spark.createDataFrame([(held_out[0],)] * 5000, "t string")))
    assert sorted(r[0] if not isinstance(r, str) else r for r in seen[0]) == sorted(set(held_out))


@pytest.mark.parametrize("text, meant, wrong", [("最終季將於明年播出", "big5", "latin-1"), ("마지막 시즌은 내년 봄에 공개됩니다", "euc_kr", "latin-1"), ("最终季将于明年播出", "gb18030", "cp1252"), ("最終シーズンは来年春に配信予定", "gb18030", "latin-1")])
def test_chinese_and_korean(text, meant, wrong):
    import numpy as np

    table = np.zeros(E.SIZE, dtype=np.int64)
    E.count_into(table, [*CLEAN, text] * 40)
    assert E.verdict(E.Chains(table.astype(np.float32)), E.MARGINS, broken(text, meant, wrong))[1] == text


def test_parts_are_restored_each_by_its_chain(chains):
    text = CLEAN[0].replace("empezó", broken("empezó", "utf-8", "cp1252")).replace("compañía", broken("compañía", "utf-8", "mac-roman"))
    assert E.verdict(chains, E.MARGINS, text)[1] == CLEAN[0]
    beside = E.verdict(chains, E.MARGINS, "Espa\ufffda, " + broken("según la compañía", "utf-8", "cp1252"))
    assert beside[0].startswith("lost") and beside[1] == "Espa\ufffda, según la compañía"


def test_what_is_no_text_is_not_handed_out(chains):
    garbled = broken(CLEAN[0], "utf-8", "cp1252")
    assert E.verdict(chains, {**E.MARGINS, "level": -0.01}, garbled)[1] is None and E.verdict(chains, {**E.MARGINS, "level": -20.0}, garbled)[1] == CLEAN[0]


def test_utf8_any_number_of_times(chains):
    text = CLEAN[4]
    for _ in range(5):
        text = broken(text, "utf-8", "cp1252")
    assert E.verdict(chains, E.MARGINS, text)[1] == CLEAN[4]


def test_escape_sequences(chains):
    assert E.verdict(chains, E.MARGINS, CLEAN[8].encode("iso2022_jp_2").decode("ascii"))[1] == CLEAN[8]


def test_weights_count_like_repeats():
    import numpy as np

    a, b = np.zeros(E.SIZE, dtype=np.int64), np.zeros(E.SIZE, dtype=np.int64)
    E.count_into(a, ["añ", "b"], [3, 2])
    E.count_into(b, ["añ", "b", "añ", "b", "añ"])
    assert (a == b).all()


def test_restoration_is_measured(spark):
    df = spark.createDataFrame([(f"{t} {i}",) for i in range(60) for t in CLEAN], "t string")
    told = E.restoration(spark, df).collect()
    assert told and all(r.exact <= r.found <= r.texts for r in told) and sum(r.exact for r in told if r.kind == "utf8") >= 0.9 * sum(r.texts for r in told if r.kind == "utf8")


# --- residue --------------------------------------------------------------------------------------------------

REAL = "The third season of Paper Ferry premieres May 3, 2026 with 8 episodes. "


@pytest.mark.parametrize("text, kind", [
    (REAL + "It was written by {{author}}.", "slot"), ("${title} returns", "slot"), ("Season %s is here", "slot"), ("%provider% joins", "slot"), ("[series_title] returns", "slot"),
    ("Welcome, [object Object]!", "slot"), ("[QUOTE TO COME]", "slot"), (REAL + "(photo caption here)", "slot"), ("<provider> joins", "slot"), ("__title__ is back", "slot"),
    ("The series averaged 12.undefined million", "slot"), ("{0} is back", "slot"), ("<?php echo $x; ?> is", "slot"), ("*|NAME|* is", "slot"), (REAL + "\n// TODO: add synopsis", "slot"),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit", "filler"), (REAL + "\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit sed do.\n\n" + REAL, "filler"),
    ("Your text goes here. Your text goes here. Your text goes here.", "filler"), ("N/A\nN/A\nN/A\nN/A", "filler"), ("Title 1: lorem\nLead 2: text\nBody 3: copy", "filler"), ("asdf qwerty foo bar blah", "filler"),
    ("404 Not Found\nThe requested URL /a-b was not found on this server.", "message"), ("Home | Shows | Press\nYou need to enable JavaScript to run this app.\n© 2026 X", "message"),
    ("<h1>Access Denied</h1><p>You don't have permission to access \"/x\" on this server.</p>", "message"), ("Seite nicht gefunden (Fehler 404). Zurück zur Startseite.", "message"), ("Za prikaz ove stranice uključite JavaScript.", "message"),
])
def test_residue(text, kind):
    assert R.residue(text) == kind


@pytest.mark.parametrize("note", ["(quote to come)", "(placeholder)", "(add photo)", "(Zitat folgt)", "(aquí va la cita)", "(por añadir)", "(à compléter)", "(ovdje ide citat)", "(insert name)"])
def test_note_in_round_brackets(note):
    assert R.residue(f"Paper Ferry is back. {note} It starts in May.") == "slot"


@pytest.mark.parametrize("opener, closer", [("{{", "}}"), ("${", "}"), ("{%", "%}"), ("<%", "%>"), ("<?", "?>"), ("[%", "%]"), ("#{", "}"), ("*|", "|*"), ("<!--#echo ", "-->")])
def test_long_slot(opener, closer):
    inner = "if show.season | default('x') " * 12
    assert R.residue(f"{REAL}{opener} {inner}{closer} {REAL}" + "More of it. " * 20) == "slot"
    assert R.SLOT.search(f"{opener} a " * 20_000) is None or opener == "<!--#echo "


LONG_MARKUP = "<html><head>\n<style>\n" + "".join(f".card{i} {{ color: red; margin: {i}px auto }}\n" for i in range(80)) + "</style><script>" + "".join(f"window.app{i} = load('shows');\n" for i in range(40)) + "</script></head>\n"
TRACE = "HTTP Status 500 - Internal Server Error\nException in thread \"main\" java.lang.NullPointerException\n" + "\n".join(f"\tat tv.paper.web.Page$View{i}.render(Page.java:{i})" for i in range(90))


@pytest.mark.parametrize("text", [
    LONG_MARKUP + "<body><h1>Access Denied</h1><p>You don't have permission to access this page on this server.</p></body></html>", TRACE,
    "404 Not Found\nThe requested URL /a-b was not found on this server.\n" + "".join(f"Home | Shows {i} | Press | Contact\n" for i in range(100)), "".join(f"Home | Shows {i} | Press | Contact\n" for i in range(60)) + "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.",
])
def test_message_on_a_long_page(text):
    assert len(text) > 1500 and R.residue(text) == "message"


def test_real_content_on_a_long_page():
    said = " ".join(f"Part {i} of Paper Ferry follows in spring." for i in range(99))
    assert R.residue(LONG_MARKUP + f"<p>{said}</p><p>Access denied</p></html>") is None and R.residue("Access denied. Please try again later.\n" + said) is None


@pytest.mark.parametrize("text", [
    None, "", " \n", REAL, "Short.", REAL + "The fake papers were filled with lorem ipsum until she wrote real headlines.", REAL + "\nTo see comments enable JavaScript.",
    "In its logo the series is stylised as {AFFAIR}, braces included. " + REAL, "Interns mailed a kit addressed to “Dear [Name]”, she said. " + REAL, "[laughs] “I can't tell you that.” [pause] “Ask her.” " + REAL,
    "The script left the year undefined on purpose. " + REAL, "“Access denied,” says the voice. " + REAL, '{"@type":"TVSeason","name":"X","seasonNumber":4}\n' + REAL, "Up 34% on the year before, about $5m per season. " + REAL,
    REAL * 2, "The terminal flashes “404 – room not found”, a joke. " + REAL, "<p>" + REAL + "</p>",
])
def test_real_content(text):
    assert R.residue(text) is None


@pytest.mark.parametrize("text", [
    "None returned his calls.", "He said [city] officials agreed.", "Her TODO: buy milk.", "Ask for <title> tags.", "The XXXX mark is a trademark.", "The tag {title} stands for a name, braces included.",
    "Results came in (more to come on that later in the week from the people who were there at the time).",
])
def test_words_that_only_look_like_slots(text):
    assert R.residue(text) is None


@pytest.mark.parametrize("text, kind", [
    ("This page can't be displayed right now. Our servers are overloaded.", "message"), ("Access Denied\nİ You don't have permission to access this page İ", "message"),
    ("Home | Shows\n" + "".join(f"Home | Shows {i} | Press | Contact\n" for i in range(400)) + "404 Not Found\nThe requested URL /a was not found on this server.", "message"),
    ("// TODO: add synopsis", "slot"), ("Die „Serie“, sagte [provider].", "slot"), ("In [city] on [date] the show returns.", "slot"), ("A (" + "placeholder " * 3 + ") here", "slot"),
    ("{{ " + "x" * 300 + " }}", "slot"),
    ("Real words are here.\n\nMenda vesti orsa belit turpa menda. Vesti orsa noctur belit menda turpa vesti orsa belit.\n\nThe end of it.", "filler"),
])
def test_more_residue(text, kind):
    assert R.residue(text) == kind


@pytest.mark.parametrize("text", [
    "Error 503\nBackend fetch failed", "Sorry, you have been blocked. You are unable to access this site.", "This site can't be reached. The connection was reset.", "Please enable JS and disable any ad blocker",
    "La página que buscas no existe. Volver al inicio.", "Cette page n'existe pas ou a été déplacée.", "Diese Seite existiert nicht oder wurde verschoben.", "Tražena stranica ne postoji.", "Just a moment... Checking your browser before accessing tv.example.",
])
def test_well_known_messages(text):
    said = " ".join(f"Part {i} of Paper Ferry follows in spring." for i in range(9))
    assert R.residue(text) == "message" and R.residue(f"{REAL}{said}\n{text}") is None


@pytest.mark.parametrize("text", [
    "The series is no longer available on Lumora.", "Paper Ferry is unavailable right now in Croatia.", "Access to the set was denied, and the crew said so.", "The show has been removed from the schedule by its network.",
    "Season two isn't available in your region until May.", "He typed 404 not found on his phone and laughed at the joke with her.",
])
def test_news_in_the_words_of_messages(text):
    assert R.residue(text) is None


def test_slot_beside_a_letter():
    assert R.residue("The story puts off a letter dated <date> while Vrsnik freezes over.") == "slot"


def test_wordings_of_notes():
    assert R._wordings("add (?:a |the )?(?:quote|link)") == ["add a quote", "add a link", "add the quote", "add the link", "add quote", "add link"]
    assert R._alternatives("a|b (?:c|d)|e") == ["a", "b (?:c|d)", "e"]


def test_all_documents_are_judged_once(spark):
    df = spark.createDataFrame([(1, "{{x}}"), (1, "fine text"), (2, None), (3, " ")], "doc_id long, text string")
    assert sorted(map(tuple, R.judged(df, ["doc_id"], "text").collect()), key=str) == sorted([(1, "slot"), (1, None), (2, None), (3, None)], key=str)


def test_find_residue_in_spark(spark):
    df = spark.createDataFrame([(1, "{{x}}"), (1, "{{x}}"), (2, None), (3, ""), (4, " ".join(f"{REAL}Part {i} follows." for i in range(2000)))], "doc_id long, text string").withColumn("residue", F.lit("clash"))
    assert sorted(tuple(r) for r in R.find_residue(df, "doc_id", "text").collect()) == [(1, "slot"), (1, "slot")]


# --- queries --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["p3_names_changed", "p6_round_trip", "p7_faults", "p8_unassigned"])
def test_results_that_must_be_empty(spark, name):
    import os

    from factloom.llm import catalogue

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    assert name in catalogue.ORACLES and catalogue.QUERIES[name](spark, sf).count() == 0


def test_many_capacities(spark, tmp_path):
    from factloom.llm import plans

    spark.createDataFrame([(i, 8 + i) for i in range(300)], "capacity_id int, capacity_tokens int").write.parquet(f"{tmp_path}/pack_capacities.parquet")
    spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.p7_containers(spark, f"file://{tmp_path}").collect()
    assert len(got) == 300 and {r.doc_id for r in got} == {1} and {r.n_tokens for r in got} == {2}
