import math
import random

import pytest
from pyspark.sql import functions as F

from gaugemill.llm import language as g


def test_query_on_documents_and_pages(spark, small):
    rows = g.op1_language(spark, small).collect()
    n_docs, n_pages = (spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("documents", "pages"))
    assert sum(r.doc_id is not None for r in rows) == n_docs and sum(r.page_id is not None for r in rows) == n_pages
    assert sum(r.language == r.declared for r in rows) >= 0.97 * len(rows)
    assert sum(r.kept for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.posterior <= 1 for r in rows)


def fits(make):
    en, fr = "the house of the king and the queen that was there ", "la maison de la reine et du roi que nous avons vue "
    return [(i, (en if i % 2 else fr) * 3 + str(i), "en" if i % 2 else "fr", f"host{i % 2}") for i in range(60)]


def test_evidence_is_fused(make):
    rows = fits(make) + [(100, "la maison de la reine et du roi que nous avons vue", "en", "host1"), (101, "the king and the queen", None, None), (102, "zz", "fr", "host0"), (103, "zz", "en", "host1"), (104, "12345 !!", "fr", "host0"), (105, None, "en", "host1")]
    got = {r.doc_id: r for r in g.identify(g.document_rows(make(rows))).collect()}
    assert got[100].language == "fr" and got[101].language == "en"  # the text outweighs what is declared
    assert got[102].language == "fr" and got[103].language == "en"  # declaration and host decide where the text says little
    assert (got[104].language, got[104].kept, got[105].language, got[105].kept) == ("fr", False, "en", False)
    assert all(got[i].kept for i in range(60))


def test_fusion_equals_a_plain_recomputation(make):
    """The four kinds of evidence counted and multiplied in plain Python, from the texts' likelihoods alone."""
    rnd = random.Random(3)
    en, fr = "the house of the king and the queen that was there ".split(), "la maison de la reine et du roi que nous avons vue ".split()
    rows = []
    for i in range(150):
        real = rnd.random() < 0.6
        text = " ".join(rnd.choice(en if real else fr) for _ in range(rnd.choice([0, 1, 2, 5, 40])))
        right = "en" if real else "fr"
        rows.append((i, text, rnd.choice([right] * 6 + ["en", "fr", None, "zz top"]), rnd.choice([f"h{int(real)}"] * 3 + ["h0", "h1", None, f"x{i}"])))
    evidence = g.document_rows(make(rows))
    languages, logs = g.fit(evidence)
    read = {r.doc_id: r for r in g.read_texts(evidence, logs).collect()}
    k = range(len(logs))
    p = {}
    for i, r in read.items():
        soft = [math.exp(x - max(r.ll)) for x in r.ll]
        p[i] = [x / sum(soft) for x in soft]
    heard = [i for i in read if read[i].n > 0]
    total = [sum(p[i][j] for i in heard) for j in k]
    prior = [(x + 1) / (sum(total) + len(total)) for x in total]
    sums = lambda keep: [sum(p[i][j] for i in heard if keep(read[i])) for j in k]
    got = {r.doc_id: r for r in g.identify(evidence).collect()}
    for i, r in read.items():
        host, domain, stated = sums(lambda x: x.host == r.host), sums(lambda x: x.domain == r.domain), sums(lambda x: x.declared == r.declared)
        own = p[i] if r.n > 0 else [0.0] * len(total)
        score = []
        for j in k:
            d = (max(domain[j] - host[j], 0) + g.SMOOTH * prior[j]) / (max(sum(domain) - sum(host), 0) + g.SMOOTH)
            h = (max(host[j] - own[j], 0) + g.SMOOTH * d) / (max(sum(host) - (r.n > 0), 0) + g.SMOOTH)
            s = (stated[j] + g.SMOOTH * prior[j]) / (sum(stated) + g.SMOOTH) / prior[j] if r.declared in languages else 1
            score.append(math.log(h) + r.ll[j] + math.log(s))
        best = max(score)
        assert got[i].posterior == pytest.approx(1 / sum(math.exp(x - best) for x in score))
        assert got[i].language == [*languages, None][score.index(best)]


def test_wrong_declarations_are_overruled(spark):
    """Rows of the real table whose declaration is replaced by a wrong one are still told by their text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = F.element_at(F.create_map(*(F.lit(x) for x in ("en", "de", "de", "en", "fr", "es", "es", "fr"))), F.col("lang"))
    spoiled = docs.withColumn("right", F.col("lang")).withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 20 == 0, F.coalesce(wrong, F.lit("en"))).otherwise(F.col("lang")))
    told = g.identify(g.document_rows(spoiled.drop("right"))).select("doc_id", "language", "kept").join(spoiled.select("doc_id", "right", "lang", "n_chars"), "doc_id").where("right <> lang and n_chars > 200").collect()
    assert len(told) > 20 and sum(r.language == r.right for r in told) >= 0.95 * len(told)


def test_large_and_missing_ids_are_exact(make):
    ids = [2**53 + 1, 2**53 + 3, None, -(2**62) - 1]
    got = g.identify(g.document_rows(make([(i, "the house of the king", "en", "a") for i in ids]))).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)


def test_models_are_bounded_whatever_the_number_of_languages():
    assert g.buckets(4) == 1 << 16 and all(g.buckets(n) * (n + 1) <= g.MOST_CELLS and g.buckets(n) >= 64 for n in (1, 63, 64, 1000, 18_252))


def test_pages_are_taken_apart(spark):
    pages = spark.createDataFrame([(1, "https://user@Blog.Example.co:8080/x", "<!-- the --><HTML class='a' LANG=\"EN-us\"><script>if(a<b){}</script><p>Hello&nbsp;you</p>"), (2, None, None), (3, "nothing", "text")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in g.page_rows(pages).collect()}
    assert (rows[1].host, rows[1].domain, rows[1].suffix, rows[1].declared, rows[1].text.split()) == ("blog.example.co", "example.co", "co", "en", ["Hello", "you"])
    assert (rows[2].host, rows[2].declared, rows[2].text) == (None, None, None) and rows[3].suffix is None


def test_odd_rows(odd, none, make):
    got = g.identify(g.document_rows(odd)).collect()
    assert len(got) == 11
    rows = make(fits(make)).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    kept = g.known_language(rows)
    assert kept.columns == rows.columns and 60 <= kept.count() <= 67
    assert kept.where("text is null or trim(text) = ''").count() == 0
    assert g.identify(g.document_rows(none)).count() == 0 and g.known_language(none).count() == 0
    assert g.known_language(odd).columns == odd.columns


def test_rare_languages_count_and_others_are_rejected(make):
    rare = ["kuningas ja kuningatar olivat talossa jonka me näimme", "talo jossa kuningas oli ja jonka kuningatar näki", "me näimme talon ja kuninkaan jotka olivat siellä"]
    junk = ["qzxv kjhw wqpz xxkq vvzj qkwx zpqj hxvk wzzq jjkx", "ξένη γλώσσα που δεν δηλώνεται πουθενά εδώ μέσα στο κείμενο"]
    rows = [(i + 100 * k, t, d, h) for k in range(120) for i, t, d, h in fits(make)]  # 7,200, so six are below one in a thousand
    rows += [(20000 + i, rare[i % 3] * 3, "fi", "host0") for i in range(6)] + [(30000 + i, t * 3, None, "host0") for i, t in enumerate(junk)]
    got = {r.doc_id: r for r in g.identify(g.document_rows(make(rows))).where("doc_id >= 20000 or doc_id < 60").collect()}
    assert all((got[20000 + i].language, got[20000 + i].kept) == ("fi", True) for i in range(6))
    assert all((got[30000 + i].language, got[30000 + i].kept) == (None, False) for i in range(2))
    assert all(got[i].kept and got[i].language == ("en" if i % 2 else "fr") for i in range(60))
