"""Mention counting, order, links, excerpt and sentiment."""

import re

import pytest
from pyspark.sql import functions as F

from answerlens.functions.urls import domain_matches, domain_of, is_public_url
from answerlens.operators import mentions as M


#: Text, names, mentions and first index, counted by hand.
CASES = [
    ("Tide boats are calm", ["Tide"], 1, 0), ("Tideline is another word", ["Tide"], 0, -1), ("old quay inn, Old Quay Inn", ["Old Quay Inn"], 2, 0),
    ("at the Old-Quay-Inn", ["Old Quay Inn"], 1, 7), ("Old Quay Inn is full.", ["Old Quay Inn", "Old Quay"], 1, 0),
    ("Old Quay Inn is full. Old Quay is not.", ["Old Quay Inn", "Old Quay"], 2, 0), ("Old Quay Inn is full.", ["Old Quay", "Old Quay Inn"], 1, 0),
    ("k m n m n", ["k m", "m n"], 2, 0), ("p q p q p", ["p q p", "q p"], 2, 0), ("q p q p", ["p q p", "q p"], 1, 2),
    ("F# and f#m, (F#)", ["F#"], 2, 0), ("Île île ÎLES", ["île"], 2, 0), ("x.y.z x.y", ["x.y", "y.z"], 2, 0), ("", ["Tide"], 0, -1),
    ("Tide", [], 0, -1), ("Tide", ["T"], 0, -1), ("Old  \n Quay", [" Old Quay "], 1, 0), ("under_score Tide_x", ["Tide"], 1, 12),
]


def test_counts_by_hand(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, text string, names array<string>")
    got = {r["i"]: (r["mentions"], r["first_index"]) for r in M.count_mentions(df).collect()}
    assert got == {i: c[2:] for i, c in enumerate(CASES)}


def owned_words(text):
    """Mentions of "of the", "the in" and "in the" by marking words: longer in characters first, then in the order given; each word has one owner."""
    found = [(m.start(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
    glue = [re.fullmatch(r"[\s\-]+", text[a + len(w) : b]) is not None for (a, w), (b, _) in zip(found, found[1:], strict=False)]
    owner = [False] * len(found)
    starts = []
    for pair in (("of", "the"), ("the", "in"), ("in", "the")):
        for i in range(len(found) - 1):
            if (found[i][1], found[i + 1][1]) == pair and glue[i] and not owner[i] and not owner[i + 1]:
                owner[i] = owner[i + 1] = True
                starts.append(found[i][0])
    return len(starts), min(starts, default=-1)


def test_overlapping_names_on_whole_documents(spark):
    names = ["of the", "the in", "in the"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").withColumn("names", F.array(*map(F.lit, names)))
    for r in M.count_mentions(docs).collect():
        assert (r["mentions"], r["first_index"]) == owned_words(r["text"])


@pytest.fixture(scope="module")
def analysed(spark):
    sites = spark.createDataFrame([(1, "Old Quay Inn", ["Quay Inn"], "oldquay.example")], "site_id int, brand_name string, brand_aliases array<string>, domain string")
    rivals = spark.createDataFrame([(1, "Marlin", "marlin.example", []), (1, "Heron House", "www.heron.example", []), (1, "Nodomain", None, None)], "site_id int, name string, domain string, aliases array<string>")
    url = lambda *u: [(x, None) for x in u]
    answers = {
        "first": ("The Old Quay Inn is excellent for families. Marlin has fewer rooms. Heron House opens in May.", url("https://oldquay.example/", "https://marlin.example/"), None),
        "third": ("Marlin comes up most. Heron House follows. The Old Quay Inn is further out.", [], None),
        "sov": ("Old Quay Inn, once Quay Inn, by the sea. Marlin. Marlin. Heron House.", [], None),
        "linked": ("There are several inns near the harbour.", url("https://oldquay.example/rooms"), None),
        "uncited": ("People name Marlin and Heron House.", url("https://marlin.example/"), None),
        "dedupe": ("Old Quay Inn.", url("https://oldquay.example/a", "https://oldquay.example/a?ref=x", "", "https://marlin.example/", "https://news.heron.example/x#y"), None),
        "negative": ("The Old Quay Inn is overpriced and guests report complaints about noise.", [], None),
        "neutral": ("The Old Quay Inn is by the water.", [], None),
        "errored": ("Old Quay Inn", url("https://oldquay.example/"), "Request timed out"),
        "long": ("waves  roll " * 60 + "Quay Inn closes " + "sand " * 120, [], None),
        "many": ("Marlin", url(*[f"https://e{i}.example/" for i in range(30)], "https://oldquay.example/late"), None),
    }
    df = spark.createDataFrame([(k, 1, a, u, e) for k, (a, u, e) in answers.items()], "k string, site_id int, answer string, urls array<struct<url:string,title:string>>, error string")
    return {r["k"]: r for r in M.analyse_response(df, M.build_dictionary(sites, rivals)).collect()}


def rival(row, name):
    return next(c for c in row["competitor_mentions"] if c["name"] == name)


def test_order_and_share(analysed):
    r = analysed["first"]
    assert (r["brand_cited"], r["brand_position"], r["domain_linked"], r["brand_mentions"], r["sentiment"]) == (True, 1, True, 1, "positive")
    assert [c["name"] for c in r["competitor_mentions"]] == ["Heron House", "Marlin", "Nodomain"]
    assert rival(r, "Marlin")["linked"] and not rival(r, "Heron House")["linked"] and not rival(r, "Nodomain")["linked"]
    assert analysed["third"]["brand_position"] == 3 and rival(analysed["third"], "Marlin")["position"] == 1
    assert (analysed["sov"]["brand_mentions"], analysed["sov"]["share_of_voice"]) == (2, 0.4)


def test_links(analysed):
    assert (analysed["linked"]["brand_mentions"], analysed["linked"]["brand_cited"], analysed["linked"]["brand_position"]) == (0, True, None)
    d = analysed["dedupe"]
    assert [u["is_brand"] for u in d["citation_urls"]] == [True, False, False] and rival(d, "Heron House")["linked"]
    assert len(analysed["many"]["citation_urls"]) == 31 and analysed["many"]["domain_linked"]


def test_uncited_and_errored(analysed):
    r = analysed["uncited"]
    assert (r["brand_cited"], r["brand_position"], r["share_of_voice"], r["sentiment"]) == (False, None, 0.0, None)
    assert sum(c["mentions"] > 0 for c in r["competitor_mentions"]) == 2
    e = analysed["errored"]
    assert (e["brand_cited"], e["citation_urls"], e["competitor_mentions"], e["response_excerpt"], e["error"]) == (False, [], [], "", "Request timed out")


def test_sentiment_and_excerpt(analysed):
    assert analysed["negative"]["sentiment"] == "negative" and analysed["neutral"]["sentiment"] == "neutral"
    text = "waves  roll " * 60 + "Quay Inn closes " + "sand " * 120
    clean, at = " ".join(text.split()), text.index("Quay")
    assert analysed["long"]["response_excerpt"] == "…" + clean[at - 140 : at + 280].strip() + "…"


def test_a_site_with_100_000_competitors(spark):
    """Found by their first words or their domain; equal to the search through the whole list where that is short."""
    sites = spark.createDataFrame([(1, "Old Quay Inn", [], "oldquay.example"), (2, "Tide", [], None)], "site_id int, brand_name string, brand_aliases array<string>, domain string")
    many = spark.range(100_000).selectExpr("1 AS site_id", "concat('Rival ', id) AS name", "concat('r', id, '.example') AS domain", "array(concat('The ', id, 'th House'), 'Rival') AS aliases")
    answers = [("a", 1, "Rival 77 and the 99998th house beat Old Quay Inn. RIVAL-77!", ["https://shop.r5.example/x", "https://r77.example"]), ("b", 1, "nothing here", []), ("c", 2, "Rival 77. Tide.", [])]
    df = spark.createDataFrame([(k, i, t, [(u, None) for u in us]) for k, i, t, us in answers], "k string, site_id int, answer string, urls array<struct<url:string,title:string>>")
    # The alias "Rival" is everyone's: without it an answer has its own few names only.
    some = many.withColumn("aliases", F.slice("aliases", 1, 1))
    got = {r["k"]: r for r in M.analyse_response(df, M.build_dictionary(sites, some), absent=False).collect()}
    names = {k: [(c["name"], c["mentions"], c["position"], c["linked"]) for c in r["competitor_mentions"]] for k, r in got.items()}
    assert names == {"a": [("Rival 5", 0, None, True), ("Rival 77", 2, 1, True), ("Rival 99998", 1, 2, False)], "b": [], "c": []}
    assert (got["a"]["brand_position"], got["a"]["share_of_voice"], got["c"]["brand_mentions"], got["c"]["share_of_voice"]) == (3, 0.25, 1, 1.0)
    assert len(M.analyse_response(df.where("k = 'b'"), M.build_dictionary(sites, some)).first()["competitor_mentions"]) == 100_000


def test_index_keys_lose_no_match(spark):
    """A text that a name matches asks for the name's key, whatever the spelling."""
    names = ["F#", "x.y", "Old-Quay Inn", "île", "#1 Shop", "K2", "Straße", "istanbul", "--", "İzmir", "Kelvin", "a_b", " Old  Quay "]
    texts = ["f# x.Y OLD quay\ninn ÎLE #1 shop", "k2 STRAßE İSTANBUL -- izmir", "\u212a2 \u212aelvin \u017fhop straße A_B", "old quay", "", "x y x.y"]
    df = spark.createDataFrame([(t, n) for t in texts for n in names], "text string, name string").withColumn("names", F.array("name"))
    df = M.count_mentions(df).withColumn("asked", F.expr(f"exists({M.name_keys_sql('names')}, k -> array_contains({M.text_keys_sql('text')}, k))"))
    rows = df.collect()
    assert sum(r["mentions"] > 0 for r in rows) >= 12 and all(r["asked"] for r in rows if r["mentions"])


def test_domains(spark):
    cases = [("www.quay.co.example", "quay.co.example", True), ("log.quay.co.example", "quay.co.example", True), ("newquay.co.example", "quay.co.example", False), ("", "a", False), ("a", None, False)]
    df = spark.createDataFrame(cases, "c string, t string, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", domain_matches(F.col("c"), F.col("t")).alias("got")).collect())
    urls = {"https://www.Quay.co.example/p?x=1": "quay.co.example", "nope": "", "http://u:p@H.example:81": "h.example"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["d"] for r in df.select("u", domain_of(F.col("u")).alias("d")).collect()} == urls


def test_public_urls(spark):
    cases = {
        "https://example.com/": True, "http://localhost:3000/": False, "http://a.localhost/": False, "http://127.0.0.1/": False, "http://10.1.2.3/": False,
        "http://192.168.1.5/": False, "http://169.254.169.254/": False, "http://100.70.0.1/": False, "http://8.8.8.8/": True, "http://[::1]/": False,
        "http://[fe80::1]/": False, "http://[::ffff:10.0.0.1]/": False, "http://[2001:db8::1]/": True, "https://user:pw@example.com/": False, "ftp://example.com/": False,
        "http://172.32.0.1/": True, "http://239.1.1.1/": False,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["p"] for r in df.select("u", is_public_url(F.col("u")).alias("p")).collect()} == cases


def test_a_busy_site_meets_its_names_in_many_places(spark):
    rows = [(n, None if n % 50 == 49 else "none" if n % 50 == 48 else "busy", f"Acme and Rival {n % 7}" if n % 3 else "nothing") for n in range(300)]
    urls = "array(named_struct('url', 'https://shop.rival.example/a', 'title', 't'))"
    answers = spark.createDataFrame(rows, "k int, site_id string, answer string").withColumn("urls", F.expr(urls))
    sites = spark.sql("SELECT 'busy' AS site_id, 'Acme' AS brand_name, cast(array() AS array<string>) AS brand_aliases, 'acme.example' AS domain")
    rivals = spark.sql("SELECT 'busy' AS site_id, concat('Rival ', id) AS name, if(id = 0, 'rival.example', '') AS domain, cast(array() AS array<string>) AS aliases FROM range(7)")
    names = M.build_dictionary(sites, rivals)
    plain, dealt = ({r["k"]: r for r in M.analyse_response(answers, names, per_salt=n).collect()} for n in (10_000, 20))
    assert dealt == plain and len(plain) == 300
    assert plain[1]["brand_mentions"] == 1 and [m["name"] for m in plain[1]["competitor_mentions"] if m["mentions"]] == ["Rival 1"]
    busy = M._busy_sites(answers, 20)
    assert [tuple(r) for r in busy.collect()] == [("busy", 14)]  # 288 answers
    assert M._dealt(names, busy).count() == 15 * names.count()


def test_only_words_that_can_name_something_are_shuffled(spark):
    """An answer's words were all rows of the join, named or not."""
    asked = spark.range(20_000).select("id", F.concat(F.lit("word "), F.col("id") % 5_000).alias("key"))
    named = spark.createDataFrame([("word 7",), ("word 4999",), ("",), (None,)], "key string")
    got = [r["id"] for r in M.may_name(asked, named).collect()]
    assert {i for i in range(20_000) if i % 5_000 in (7, 4999)} <= set(got) and len(got) < 40
    assert M.may_name(asked, named.limit(0)).count() == 0


def test_whole_answers_move_by_many_keys(spark):
    """A site's answers meet its brand in ten times as many places as its names, so no task gets many times its share."""
    answers = spark.range(300).selectExpr("1L AS site_id", "concat('Acme ', id) AS answer", "array(named_struct('url', '', 'title', '')) AS urls")
    sites = spark.sql("SELECT 1L AS site_id, 'Acme' AS brand_name, cast(array() AS array<string>) AS brand_aliases, 'acme.example' AS domain")
    rivals = spark.sql("SELECT 1L AS site_id, 'Rival' AS name, '' AS domain, cast(array() AS array<string>) AS aliases")
    sized, kept = M._busy_sites, []
    M._busy_sites = lambda *a: kept.append(sized(*a)) or kept[-1]
    try:
        rows = M.analyse_response(answers, M.build_dictionary(sites, rivals), per_salt=100).collect()
    finally:
        M._busy_sites = sized
    assert [[tuple(r) for r in k.collect()] for k in kept] == [[(1, 3)], [(1, 30)]]
    assert len(rows) == 300 and all(r["brand_mentions"] == 1 and r["competitor_mentions"][0]["mentions"] == 0 for r in rows)
