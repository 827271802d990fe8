"""Variant spellings of organisation names, linked by a pigeonhole segment join.

A distinct spelling is parsed into the words that name the organisation; legal forms, notes and the
line of business are set aside, nicknames become full names. Words in one string are cut into k+1
segments; two strings within k edits share one segment at a position shifted by at most k, so
segments go into an inverted index by (length, number, text), shifted substrings are looked up
there, and a banded edit distance verifies. Word orders are index entries of their own. Linked
spellings form components. Acronyms, first words alone and words cut short join a component if it
is the only one they fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.canonical import Trie
from hirelake.llm.components import connected_components
from hirelake.session import cut
from hirelake.sources.tables import table

MAX_EDITS = 2
#: Cores shorter than this are one edit apart at most, and need the same trade; below the second, they are compared exactly.
LEAST_FUZZY = 7
LEAST_EDIT = 4

# What is typed where no employer is named.
NO_NAME = {
    "", "nan", "none", "null", "na", "n a", "nil", "unknown", "confidential", "company confidential", "private", "undisclosed", "not disclosed", "anonymous", "various",
    "tbc", "tba", "our client", "client", "employer", "company", "see advert", "not specified", "not available", "private advertiser", "hidden", "test", "vertraulich", "confidencial", "confidentiel",
}
# Legal forms and notes beside a name.
LEGAL = set("llc inc ltd co corp group grp gmbh ag sa sas sarl sl bv nv plc limited incorporated corporation company llp lp pty kg ohg ug holding holdings mbh gesellschaft the and".split())
NOTES = re.compile(r"[(\[]\s*(?:careers?|hq|hr|jobs|hiring|head ?office|head ?quarters|recruit(?:ing|er)|official)\s*[)\]]|\s[-–—|]\s*(?:careers?|hr|jobs|hiring|hq)\s*$", re.I)
# Lines of business and their short forms.
TRADES = {
    "foods": "food", "media": "", "dental": "dent", "legal": "", "brewing": "brew", "farms": "farm", "logistics": "logist logis log", "marine": "mar", "pharma": "pharmaceuticals pharmaceutical pharm",
    "airways": "airwys", "hardware": "hdwr hdw", "optics": "opt", "glass": "", "manufacturing": "mfg manuf", "systems": "sys syst system", "energy": "enrgy", "technologies": "tech technology techs",
    "hotels": "hotel htls", "instruments": "instr instrs", "consulting": "consltg cons consult", "laboratories": "labs lab", "international": "intl int", "education": "educ edu", "textiles": "txtls text",
    "packaging": "pkg packg", "builders": "bldrs", "insurance": "ins insur", "analytics": "anlytcs analyt", "finance": "fin", "engineering": "engrg eng engr", "services": "svcs svc serv", "chemicals": "chem chems",
    "surveyors": "", "plumbing": "plbg", "accountants": "accts", "roofing": "", "motors": "", "solicitors": "solrs", "bakeries": "bakery", "catering": "", "haulage": "", "nurseries": "", "joinery": "", "printing": "",
    "recruitment": "",
}
# Full first names and the short ones used for them.
NICKNAMES = {
    "robert": "bob rob bobby robbie", "william": "will bill billy willy", "richard": "rich rick dick", "michael": "mike mick micky", "james": "jim jimmy jamie", "joseph": "joe joey", "thomas": "tom tommy",
    "theodore": "theo ted", "edward": "ed eddie ned", "zachary": "zach zack", "matthew": "matt", "philip": "phil pip", "phillip": "phil", "anthony": "tony", "christopher": "chris kit", "nicholas": "nick nicky",
    "stephen": "steve", "steven": "steve", "benjamin": "ben benny", "leonard": "len lenny", "frederick": "fred freddie", "gerald": "gerry jerry", "gregory": "greg", "donald": "don donny", "raymond": "ray",
    "katherine": "kate kathy katie kath", "catherine": "cathy kate", "elizabeth": "liz beth betty lizzie", "victoria": "vicky vicki tori", "jennifer": "jenny jen", "patricia": "pat patty trish", "rebecca": "becky becca",
    "margaret": "maggie meg peggy", "deborah": "deb debbie", "cynthia": "cindy", "susan": "sue suzie", "jacqueline": "jackie", "daniel": "dan danny", "samuel": "sam", "samantha": "sam", "alexander": "alex sandy", "andrew": "andy drew",
    "david": "dave", "timothy": "tim", "kenneth": "ken", "ronald": "ron", "charles": "charlie chuck", "jonathan": "jon", "peter": "pete", "lawrence": "larry", "douglas": "doug", "vincent": "vince", "walter": "walt", "harold": "harry hal", "henry": "harry hank",
    "barbara": "barb", "pamela": "pam", "dorothy": "dot dottie", "judith": "judy", "sandra": "sandy", "christine": "chris tina", "theresa": "terry tess", "albert": "al bert", "abigail": "abby", "amanda": "mandy", "josephine": "jo josie", "francis": "frank", "eleanor": "ellie nell", "valerie": "val",
}


def _one_name(nicknames: dict[str, str]) -> dict[str, str]:
    """Every full or short first name to one representative; names that share a short form are one."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for full, shorts in nicknames.items():
        for s in shorts.split():
            # the longest name leads, so that a typing error in it stays near
            first, second = sorted((find(full), find(s)), key=lambda x: (-len(x), x))
            root[second] = first
    return {x: find(x) for x in {*nicknames, *(s for v in nicknames.values() for s in v.split())}}


class Parser:
    """Splits spellings into (core words, line of business, all words, acronym, first or last word cut short)."""

    def __init__(self, trades: dict[str, str] = TRADES, legal: set[str] = LEGAL, nicknames: dict[str, str] = NICKNAMES, no_name: set[str] = NO_NAME) -> None:
        self.legal, self.no_name = legal, no_name
        self.trade = {w: full for full, shorts in trades.items() for w in [full, *shorts.split()]}
        self.names = _one_name(nicknames)
        self.near = Trie()
        self.ids: list[str] = []
        for w in [*trades, "pharmaceuticals", "limited", "incorporated", "corporation", "company"]:
            if len(w) >= 5:
                self.near.add(w, len(self.ids))
                self.ids.append(self.trade.get(w, "*legal"))

    def _kind(self, w: str) -> str:
        """The trade a word stands for, '*legal', or '' for a word of the name; one typing error is forgiven."""
        if w in self.legal:
            return "*legal"
        if w in self.trade:
            return self.trade[w]
        if len(w) >= 5 and (hits := self.near.search(w, 1)):
            return self.ids[min(hits)]
        return ""

    def __call__(self, value: str | None) -> tuple | None:
        if value is None:
            return None
        text = unicodedata.normalize("NFKD", NOTES.sub(" ", value).replace("ß", "ss").lower())
        text = "".join(c for c in text if not unicodedata.combining(c))
        if " ".join(re.findall(r"\w+", text)) in self.no_name:
            return None
        text = re.sub(r"\b(?:\w\.\s?){2,}(?:\w\b)?", lambda m: re.sub(r"[.\s]", "", m[0]) + " ", text)  # Q.S.P. and S.A.
        found = re.findall(r"([^\W_]+(?:['’][^\W_]+)?)(\.?)", text)
        words = [(re.sub(r"['’]", "", w), dot) for w, dot in found]
        kinds = [self._kind(w) for w, _ in words]
        named = [i for i, k in enumerate(kinds) if k != "*legal"]
        core = [i for i in named if not kinds[i]]
        if not core:  # nothing but trades: keep them as the name
            core = named
        if not core:
            return None
        tokens = [self.names.get(words[i][0], words[i][0]) for i in core]
        trade = " ".join(sorted({kinds[i] for i in named if kinds[i]})) if core != named else ""
        everything = [words[i][0] for i in named]
        acronym = tokens[0] if len(tokens) == 1 and core == named and 2 < len(tokens[0]) < 7 else ""
        short = [i for i, c in enumerate(core) if words[c][1] or len(words[c][0]) == 1]
        return tokens, trade, everything, acronym, short[0] if len(short) == 1 else -1


PARSED = "name string, tokens array<string>, trade string, words array<string>, acronym string, short_at int"


def parsed_names(values: DataFrame, column: str, **words) -> DataFrame:
    """One row of ``PARSED`` for each distinct spelling that names an organisation; ``words`` are the lists of :class:`Parser`."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        parse = Parser(**words)
        for pdf in batches:
            rows = [(v, *p) for v in pdf["name"] if (p := parse(v))]
            yield pd.DataFrame(rows, columns=["name", "tokens", "trade", "words", "acronym", "short_at"])

    return values.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct().mapInPandas(run, PARSED)


def learned_trades(values: DataFrame, column: str, legal: set[str] = LEGAL, least_cores: int = 20, least_shared: int = 3, most: int = 2000) -> dict[str, str]:
    """Lines of business and their short forms as the spellings in ``column`` show them, in the form of ``TRADES``.

    A trade is a word of three letters or more that closes at least ``least_cores`` different names and stands last in more than half of
    the spellings that hold it; at most the ``most`` most frequent ones come to the driver. A short form begins like its trade, has its letters in
    order, and closes at least ``least_shared`` of the same names. Few or no spellings give few or no trades.
    """
    legal = frozenset(legal)

    def split(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for v in pdf["name"]:
                text = unicodedata.normalize("NFKD", NOTES.sub(" ", v).replace("ß", "ss").lower())
                words = [w for w in re.findall(r"[^\W_]+", "".join(c for c in text if not unicodedata.combining(c))) if w not in legal]
                if len(words) > 1:
                    rows.append((" ".join(words[:-1]), words[-1], words[:-1]))
            yield pd.DataFrame(rows, columns=["core", "last", "others"])

    names = values.select(F.col(column).alias("name")).where("name is not null").distinct()
    parts = cut(names.mapInPandas(split, "core string, last string, others array<string>"))
    ends = parts.where(F.length("last") > 2).groupBy("last").agg(F.count("*").alias("n"), F.count_distinct("core").alias("cores")).where(F.col("cores") >= least_cores)
    inside = parts.select(F.explode(F.array_distinct("others")).alias("last")).groupBy("last").agg(F.count("*").alias("inside"))
    trades = [r["last"] for r in ends.join(inside, "last", "left").where(F.col("n") > F.coalesce("inside", F.lit(0))).orderBy(F.desc("cores"), "last").limit(most).collect()]
    if not trades:
        return {}
    pairs = parts.select("core", "last").distinct()
    full = pairs.where(F.col("last").isin(trades)).withColumnRenamed("last", "full")
    shared = pairs.join(full, "core").where((F.length("last") < F.length("full")) & (F.length("last") > 1) & (F.left("last", F.lit(1)) == F.left("full", F.lit(1))))
    counted = shared.groupBy("full", "last").agg(F.count("*").alias("n")).where(F.col("n") >= least_shared).orderBy(F.desc("n"), "full", "last").limit(4 * most).collect()

    def in_order(short: str, full: str) -> bool:
        letters = iter(full)
        return all(c in letters for c in short)

    of: dict[str, str] = {}
    for r in counted:
        if in_order(r["last"], r.full):
            of.setdefault(r["last"], r.full)
    shorts: dict[str, list[str]] = {t: [] for t in trades if t not in of}
    for short, full in of.items():
        while full in of:
            full = of[full]
        shorts.setdefault(full, []).append(short)
    return {t: " ".join(xs) for t, xs in shorts.items()}


def with_learned(given: dict[str, str], learned: dict[str, str]) -> dict[str, str]:
    """Both lists in one; a learned word that the given list knows as a short form stays with its trade there."""
    of = {w: full for full, shorts in given.items() for w in [full, *shorts.split()]}
    out = {full: shorts.split() for full, shorts in given.items()}
    for full, shorts in learned.items():
        home = of.get(full, full)
        out[home] = list(dict.fromkeys([*out.get(home, []), *(w for w in [full, *shorts.split()] if w != home and of.get(w, home) == home)]))
    return {full: " ".join(shorts) for full, shorts in out.items()}


def _segments(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(start, size) of segment ``i`` when ``length`` letters are cut into ``parts`` nearly even segments."""
    start = F.floor(length * i / parts)
    return start.cast("int"), (F.floor(length * (i + 1) / parts) - start).cast("int")


def segment_pairs(strings: DataFrame, probes: DataFrame, k: int = MAX_EDITS, brief: bool = False) -> DataFrame:
    """(id_a, id_b) of probe strings and index strings within ``k`` edits; both have (id, s, trade).

    Every string of at least ``k`` + 1 letters is compared with all others; no bucket is capped. Trades
    must agree where both have one. A swap of neighbours counts as one edit; pairs at distance 2 without
    one need the same trade and the same first and last letters. ``brief`` asks for the same trade of all
    pairs, and for one edit or one swap of neighbours.
    """
    parts = k + 1
    ix = strings.select("id", "s", "trade", F.length("s").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    start, size = _segments(F.col("n"), F.col("i"), parts)
    ix = ix.select("n", "i", F.expr("id").alias("id_b"), F.col("s").alias("s_b"), F.col("trade").alias("trade_b"), F.substr("s", start + 1, size).alias("seg"))
    pr = probes.select("id", "s", "trade", F.length("s").alias("m"))
    pr = pr.select("id", "s", "trade", "m", F.explode(F.sequence(F.greatest(F.col("m") - k, F.lit(parts)), F.col("m") + k)).alias("n"))
    pr = pr.select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    start, size = _segments(F.col("n"), F.col("i"), parts)
    pr = pr.withColumns({"__start": start, "__size": size})
    lo, hi = F.greatest(F.lit(0), F.col("__start") - k), F.least(F.col("m") - F.col("__size"), F.col("__start") + k)
    pr = pr.where(lo <= hi).select("id", "s", "trade", "n", "i", "__size", F.explode(F.sequence(lo, hi)).alias("p"))
    pr = pr.select("n", "i", F.col("id").alias("id_a"), F.col("s").alias("s_a"), F.col("trade").alias("trade_a"), F.substr("s", F.col("p") + 1, F.col("__size")).alias("seg"))
    pairs = pr.join(ix, ["n", "i", "seg"]).where((F.col("id_a") != F.col("id_b")) & ((F.col("trade_a") == F.col("trade_b")) | (F.col("trade_a") == "") | (F.col("trade_b") == "")))
    d = F.levenshtein("s_a", "s_b", k)  # banded: -1 beyond k
    ends = (F.substring("s_a", 1, 1) == F.substring("s_b", 1, 1)) & (F.right("s_a", F.lit(1)) == F.right("s_b", F.lit(1)))
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    swap = (F.length("s_a") == F.length("s_b")) & (letters("s_a") == letters("s_b"))
    same = (F.col("trade_a") == F.col("trade_b")) & (F.col("trade_a") != "")
    pairs = pairs.select("id_a", "id_b", "s_a", "s_b", same.alias("__trade")).distinct()
    if brief:
        turned = F.expr("exists(sequence(1, greatest(length(s_a) - 1, 1)), i -> concat(substr(s_a, 1, i - 1), substr(s_a, i + 1, 1), substr(s_a, i, 1), substr(s_a, i + 2)) = s_b)")
        near = F.col("__trade") & (d.between(0, 1) | (d == 2) & turned)
    else:
        near = d.between(0, 1) | (d == 2) & (swap | ends & F.col("__trade"))
    return pairs.where(near).select("id_a", "id_b").distinct()


def linked_names(values: DataFrame, column: str, k: int = MAX_EDITS, trades: dict[str, str] | None = None, **words) -> DataFrame:
    """(name, entity) for each distinct spelling in ``column`` that names an organisation.

    ``entity`` numbers the organisation and is the same for linked spellings. The lists of trades, legal forms, nicknames and
    stand-ins are parameters (``words``, as of :class:`Parser`); without ``trades`` they are ``TRADES`` and what
    :func:`learned_trades` finds in the column itself. NULL, blank and stand-in
    values are left out. Repeated rows count once; an empty table gives no rows.
    """
    if trades is None:
        trades = with_learned(TRADES, learned_trades(values, column))
    p = parsed_names(values, column, trades=trades, **words)
    core = F.array_join(F.array_sort("tokens"), " ")
    p = cut(p.withColumn("id", F.xxhash64(core, F.col("trade"))))
    nodes = p.groupBy("id").agg(F.first(F.struct("tokens", "trade")).alias("x")).select("id", "x.tokens", "x.trade")
    nodes = nodes.withColumn("s", F.array_join("tokens", ""))
    n = F.size("tokens")
    turn = lambda i: F.concat(F.slice("tokens", i + 1, n - i), F.slice("tokens", 1, i))
    turned = nodes.select("id", "trade", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(turn(i), ""))).alias("s"))
    fuzzy = F.length("s") >= LEAST_FUZZY
    near = segment_pairs(turned.where(fuzzy), nodes.where(fuzzy).select("id", "s", "trade"), k)
    brief = F.length("s").between(LEAST_EDIT, LEAST_FUZZY)  # the longest may pair with one that is a letter shorter
    near = near.union(segment_pairs(turned.where(brief), nodes.where(brief).select("id", "s", "trade"), MAX_EDITS, brief=True))
    same = turned.alias("x").join(nodes.alias("y"), F.col("x.s") == F.col("y.s")).where("x.id <> y.id and (x.trade = y.trade or x.trade = '' or y.trade = '')").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    comps = connected_components(near.union(same), "id_a", "id_b")
    p = p.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("entity", F.coalesce("root", "id"))
    p = cut(p.select("name", "id", "entity", "tokens", "words", "acronym", "short_at"))
    size = F.size("words")
    full = p.where(size >= 2)
    # what a short spelling may stand for: initials, first two words, the last word with the first cut short
    initials = full.where(size >= 3).select(F.concat(F.lit("i:"), F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")).alias("key"), "entity", "tokens")
    first_two = full.where(F.size("tokens") >= 3).select(F.concat(F.lit("f:"), F.array_join(F.slice("tokens", 1, 2), " ")).alias("key"), "entity", "tokens")
    last = full.where(F.size("tokens") >= 2).select(F.concat(F.lit("l:"), F.element_at("tokens", -1)).alias("key"), "entity", "tokens")
    ask = F.array_compact(
        F.array(
            F.when(F.col("acronym") != "", F.concat(F.lit("i:"), "acronym")),
            F.when((F.size("tokens") == 2) | (F.size("tokens") >= 3) & (F.col("short_at") == F.size("tokens") - 1), F.concat(F.lit("f:"), F.array_join(F.slice("tokens", 1, 2), " "))),
            F.when((F.col("short_at") == 0) & (F.size("tokens") >= 2), F.concat(F.lit("l:"), F.element_at("tokens", -1))),
        )
    )
    asked = p.select("name", F.col("entity").alias("own"), F.col("tokens").alias("t"), "short_at", F.explode(ask).alias("key"))
    # word by word: equal, or the short word begins the full one; a last word cut short may stand for a later word
    m = F.size("t")
    lead = lambda i: F.startswith(F.get("tokens", i), F.get("t", i))
    whole = F.array_join(F.slice("t", 1, m - 1), " ") == F.array_join(F.slice("tokens", 1, m - 1), " ")
    tail = F.exists(F.slice("tokens", m, F.greatest(F.size("tokens") - m + 1, F.lit(0))), lambda w: F.startswith(w, F.element_at("t", -1)))
    fits = (
        F.when(F.startswith("key", F.lit("i:")), F.lit(True))
        .when(F.col("short_at") == 0, (F.size("tokens") == m) & lead(0) & (F.array_join(F.slice("t", 2, m), " ") == F.array_join(F.slice("tokens", 2, m), " ")))
        .when(F.col("short_at") == m - 1, whole & tail)
        .otherwise(F.col("short_at") < 0)
    )
    found = asked.join(initials.union(first_two).union(last), "key").where(fits & (F.col("own") != F.col("entity")))
    only = found.groupBy("own").agg(F.min("entity").alias("to"), F.count_distinct("entity").alias("n")).where("n = 1")
    # short spellings join their component; a component they named only by themselves goes with them
    merged = connected_components(only.select("own", "to"), "own", "to")
    return p.join(merged.withColumnRenamed("node", "entity").withColumnRenamed("root", "__root"), "entity", "left").select("name", F.coalesce("__root", "entity").alias("entity"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """(name_a, name_b), name_a < name_b: two different spellings in job_cache.company of the same employer."""
    linked = cut(linked_names(table(spark, sf_dir, "job_cache").select("company"), "company"))
    a, b = linked.select(F.col("name").alias("name_a"), "entity"), linked.select(F.col("name").alias("name_b"), "entity")
    # spellings in UTF-8 sort by code point
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")


def p6_entities(spark, sf_dir: str) -> DataFrame:
    """(company, entity_name, n_rows): each spelling, the most frequent spelling of its employer, and its rows."""
    rows = table(spark, sf_dir, "job_cache").groupBy("company").agg(F.count("*").alias("n_rows"))
    linked = linked_names(table(spark, sf_dir, "job_cache").select("company"), "company").withColumnRenamed("name", "company")
    both = cut(rows.join(linked, "company"))
    names = both.groupBy("entity").agg(F.max_by("company", F.struct("n_rows", "company")).alias("entity_name"))
    return both.join(names, "entity").select("company", "entity_name", "n_rows")
