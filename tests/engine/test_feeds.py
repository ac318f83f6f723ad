"""Sound and damaged feeds."""

from tidemark.sources import feeds as R

ITEM = "<item><title>T{0}</title><link>/l{0}</link><description>D &amp; d</description><pubDate>p</pubDate><guid isPermaLink='false'>g{0}</guid></item>"
TWO = ITEM.format(1) + ITEM.format(2)
WANT = [("T1", "/l1", "D & d", "p", "g1"), ("T2", "/l2", "D & d", "p", "g2")]
FORMS = {
    "sound": (f"<rss><channel><title>c</title>{TWO}</channel></rss>", "read", WANT),
    "bare ampersand": (f"<rss><channel><title>A & B</title>{TWO}</channel></rss>", "recovered", WANT),
    "cut off in the second": (f"<rss><channel>{ITEM.format(1)}<item><title>T2</title><link>/l2</link><desc", "recovered", [WANT[0], ("T2", "/l2", "", "", "/l2")]),
    "cut off in a text": (f"<rss><channel>{ITEM.format(1)}<item><title>T2 and mo", "recovered", [WANT[0], ("T2 and mo", "", "", "", "")]),
    "white space before the prolog": (f"\n\n<?xml version='1.0'?><rss><channel>{TWO}</channel></rss>", None, WANT),
    "RSS 1.0": (f"<?xml version='1.0'?><rdf:RDF xmlns:rdf='r' xmlns='p'><channel rdf:about='x'><title>c</title></channel>{TWO}</rdf:RDF>", "recovered", WANT),
    "unclosed elements": ("<rss><item><title>a<link>/b<item><title>c</item>", "recovered", [("a", "/b", "", "", "/b"), ("c", "", "", "", "")]),
    "atom": ("<feed xmlns='a'><entry><title>t</title><link rel='self' href='/self'/><link href='/alt' rel='alternate'/><link rel='alternate' href='/x'/><id>1</id><updated>u</updated></entry></feed>", "read", [("t", "/alt", "", "u", "1")]),
    "atom, one link": ("<feed><entry><title>t</title><link rel='self' href='/self'/></entry></feed>", "read", [("t", "/self", "", "", "/self")]),
    "atom, damaged": ("<feed><title>A & B</title><entry><title>t</title><link rel='self' href='/self'/><link href='/alt'/><content type='xhtml'><div><title>in</title>c</div></content></entry>", "recovered", [("t", "/alt", "inc", "", "/alt")]),
    "marked sections and references": ("<rss><item><title><![CDATA[a <b> & c]]></title><description>x &lt;i&gt; &#233; &amp;amp;</description></item>", "recovered", [("a <b> & c", "", "x <i> é &amp;", "", "")]),
    "prefixes": ("<x:rss><x:item><x:title>t</x:title><dc:date>d</dc:date><content:encoded>e</content:encoded></x:item></x:rss> & ", "recovered", [("t", "", "e", "d", "")]),
    "sound but empty": ("<rss><channel><title>c</title></channel></rss>", "empty", []),
    "malformed and empty": ("<rss><channel><title>A & B</title></channel>", "failed", []),
    "not a feed": ("no feed at all", "failed", []),
    "nothing": (None, "failed", []),
}


def test_forms(spark):
    df = spark.createDataFrame([(name, text) for name, (text, _, _) in FORMS.items()], "name string, text string")
    got: dict = {}
    for r in R.read_feeds(df, "name").collect():
        got.setdefault(r.name, (r.status, []))[1].append((r.pos, r.title, r.link, r.summary, r.published, r.id))
    for name, (_, status, want) in FORMS.items():
        rows = [x[1:] for x in sorted(got[name][1]) if x[0] is not None] if want else [x[1:] for x in got[name][1] if x[0] is not None]
        assert rows == want, name
        assert status is None or got[name][0] == status, name


def test_a_very_long_feed_and_no_feeds(spark):
    text = "<rss><channel><title>A & B</title>" + "".join(ITEM.format(i) for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "k int, text string")
    assert R.read_feeds(df, "k").filter("status = 'recovered'").count() == 20_000
    assert R.read_feeds(df.limit(0), "k").count() == 0


def test_a_batch_is_read_slice_by_slice():
    import pyarrow as pa

    texts = [f"<rss><item><title>A & {i}</title><description>{'x' * 1000}</description></item>" for i in range(200)] + ["none", None]
    batch = pa.RecordBatch.from_pydict({"k": list(range(202)), "text": texts})
    out = list(R.recovered_rows(iter([batch, batch.slice(0, 0)]), 1, 10_000))
    assert len(out) > 15 and max(b.nbytes for b in out) < 20_000
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["k"] for r in rows] == list(range(202)) and [r["title"] for r in rows[:200]] == [f"A & {i}" for i in range(200)]
    assert [(r["status"], r["pos"]) for r in rows[199:]] == [("recovered", 0), ("failed", None), ("failed", None)]
