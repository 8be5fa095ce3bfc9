from stainloom.llm.quality import quality_rules

LONG = "one two three four five six seven eight nine ten eleven twelve"
#: line, whether it stays
LINES = [
    ("The design in question has spread more than we thought.", True), ("He blogs in vain and assigns up to ten tasks.", True), ("Sign in", False), ("SIGN-IN | Register", False), ("Please read  more here", False),
    ("Mehr erfahren", False), ("En savoir plus »", False), ("Leer más", False), ("Alle Rechte vorbehalten.", False), ("home > news > sport > today", False), ("a | b | c | d", False),
    (LONG, False), (f"{LONG}.", True), (f"{LONG}. And then some more", True), (f"First. {LONG}", False), (f'He said: "{LONG}."', True), (f"{LONG}", True), ("thirteen goes on here.", True), ("A heading", True), ("", True),
    ("good $bad #bad *bad", False), (f"{LONG} please sign in {LONG} {LONG} {LONG}.", True),
]


def test_rules_by_line(spark):
    """Each line among clean ones; a line that the next one continues stays."""
    filler = [" ".join(f"{x}{i}" for x in "Every clean sentence has its own words here".split()) + "." for i in range(30)]
    text = "\n".join(x for i, (line, _) in enumerate(LINES) for x in ([line] if i == 16 else [line, filler[i]]))
    want = "\n".join(x for i, (line, stays) in enumerate(LINES) for x in ([line] if i == 16 else [line, filler[i]] if stays else [filler[i]]))
    docs = spark.createDataFrame([(1, text, "kept", "x")] * 2 + [(None, f"{LONG}\n" * 9, None, None)], "doc_id long, text string, mine string, _l string")
    got = quality_rules(docs, extra=("mine",)).collect()
    assert [r["clean_text"] for r in got if r["doc_id"]] == [want] * 2 and [r["mine"] for r in got if r["doc_id"]] == ["kept"] * 2
    assert all(r["kept"] for r in got if r["doc_id"]) and not any(r["kept"] for r in got if r["doc_id"] is None)
