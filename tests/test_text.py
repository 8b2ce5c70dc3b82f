from listwright.functions import text as tx


def test_strip_takes_all_unicode_white_space(apply):
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [f"{b}a {b} b{b}{b}" for b in blanks] + ["", " ", "a", "​a​", "  \n"]
    assert apply(tx.strip, [(t,) for t in texts], "t string") == [t.strip() for t in texts]


def test_company_key_cases(apply):
    cases = {
        " Acme, Inc. ": "acme",
        "Acme Corporation, Inc.": "acme",
        "Acme Inc, LLC": "acme inc",
        "Acme, Corporation": "acme,",
        "Acme Corp": "acme corp",
        "ACME LTD.": "acme",
        "Inc.": "inc.",
        " inc. ": "inc.",
        "": "",
        "Acme ltd  , inc.": "acme",
    }
    assert apply(tx.company_key, [(n,) for n in cases], "n string") == list(cases.values())


def test_company_key_of_suffix_chains(apply):
    cases = {
        "É Inc, LLC": "é inc",
        "acme corp. llc": "acme",
        "acme llc corp.": "acme llc",
        "acme ltd ltd.": "acme",
        "acme ltd. ltd": "acme ltd.",
        "acme inc inc": "acme inc",
        ", inc.": "",
        " , llc ,": ", llc ,",
        "acme ,inc.": "acme ,inc.",
        "acme incorporated": "acme incorporated",
    }
    assert apply(tx.company_key, [(n,) for n in cases], "n string") == list(cases.values())


def test_fingerprints(apply):
    rows = [
        ("acme", "  Data Intern ", ["NYC ", "austin", "Äa", "zz"]),
        ("acme", "", []),
        ("é", "Ünï", ["b", "A", "a"]),
    ]
    expected = ["714ff5bb01707961", "f8575bf7224d4f13", "ebef25b91d5792f3"]
    assert apply(tx.fingerprint, rows, "k string, t string, l array<string>") == expected


def test_version_changes_with_one_byte(apply):
    a, b = b"likes: tea\n", b"likes: tea \n"
    assert tx.version_of_bytes(a) != tx.version_of_bytes(b)
    assert len(tx.version_of_bytes(a)) == 12
    assert apply(tx.version_hash, [(a.decode(),)], "c string") == [tx.version_of_bytes(a)]


def test_natural_id_separates_parts(apply):
    ids = apply(tx.natural_id, [("ab", "c"), ("a", "bc"), ("ab", "c")], "a string, b string")
    assert ids[0] == ids[2] != ids[1]
    assert len(ids[0]) == 32


def test_ascii_lower_leaves_other_letters(apply):
    assert apply(tx.ascii_lower, [("ÀBCK",)], "t string") == ["ÀbcK"]
