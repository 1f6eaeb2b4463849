import re

from tideline.llm.decontaminate import decontaminate, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(rows, items):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(item) if item is not None else None)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g] - {None}
        out.append((str(doc), len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_matches_brute_force(spark, small, docs, odd, none):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    more = spark.createDataFrame([(900, "then again", "x"), (901, "Then AGAIN", "x"), (902, None, "x"), (903, "...", "x"), (None, "null id", "x"), (904, "word5 and word6 and word7 and word8 and word9 and word10 and word11 and word12", "x")], "item_id long, text string, gram string")
    for df, items in ((docs, benchmark), (odd, more), (none, more), (odd, more.limit(0))):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(df, items).collect())
        assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.select("item_id", "text").collect()])


def test_contaminated_rows_go(spark, odd):
    items = spark.createDataFrame([(1, "same text here now then again")], "item_id long, text string")
    left = drop_contaminated(odd, items)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["3", "4", "None", "None", "5", "6", "7", "8", "9"])
