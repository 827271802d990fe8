"""Free-entered values mapped to the entries of a reference list.

Reference entries go into a trie of their letters and digits, each with alias paths (abbreviated
words, the last word first, written-out umlauts). A typed value is run against the trie as a
Levenshtein automaton: the states are bit vectors, one for each number of errors, and a branch of
the trie is left as soon as no state is alive. All entries within a distance that depends on the
length of the value come back; the nearest one is taken if it is the only one so near.

Only distinct values are searched. A list goes to the Python workers in pieces that fit a worker, each with a trie of its own; what
the tries reach is put together before a value is settled, so the number of pieces changes no answer.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.sources.tables import broadcast_small, table

#: Entries of a piece of a reference list, which is one trie.
MAX_ENTRIES = 200_000
NONE_MEANT = -1

# Short forms of words in place names.
PLACE_SHORT = {
    "saint": "st", "sankt": "st", "mount": "mt", "fort": "ft", "north": "n no", "south": "s so", "east": "e", "west": "w", "port": "pt prt", "point": "pt",
    "heights": "hts", "creek": "ck crk cr", "park": "pk", "springs": "spgs", "lake": "lk", "city": "cty", "grand": "gr gd", "puerto": "pto", "san": "s sn",
    "villa": "va", "falls": "fls", "bay": "by", "cross": "x crs", "quay": "qy",
}
# Names of countries as typed, by country code.
COUNTRY_NAMES = {
    "IE": ["ireland", "irl", "ie", "rep of ireland", "republic of ireland", "eire", "irland", "irlanda"],
    "GB": ["united kingdom", "uk", "u k", "gb", "gbr", "great britain", "england", "scotland", "wales", "grossbritannien", "reino unido"],
    "DE": ["germany", "deutschland", "ger", "de", "deu", "alemania", "brd"],
    "ES": ["spain", "espana", "es", "esp", "spanien"],
    "US": ["united states", "united states of america", "usa", "us", "u s a", "u s", "america", "estados unidos", "vereinigte staaten"],
    "IN": ["india", "bharat", "in", "ind", "indien"],
    "AU": ["australia", "aus", "au", "australien"],
}
PLACE_NOISE = re.compile(r"\b(?:greater|metro(?:politan)?|area|region|city cent(?:re|er)|town cent(?:re|er)|centre|remote|hybrid|on ?site|onsite|near|nr|home ?based|home office)\b")
# Short forms of words in role names.
ROLE_SHORT = {
    "manager": "mgr mngr", "engineer": "eng engr", "developer": "dev", "administrator": "admin", "supervisor": "supv supvr", "teacher": "tchr",
    "assistant": "asst", "officer": "ofc off ofcr", "therapist": "ther", "operator": "oper op", "technician": "tech", "specialist": "spec splst", "marketing": "mktg",
    "coordinator": "coord", "database": "db", "analyst": "anlst anl", "accountant": "acct accnt", "accounts": "accts", "executive": "exec", "instructor": "instr",
    "machine": "mach", "associate": "assoc", "warehouse": "whse", "secretary": "secy sec", "consultant": "cons", "representative": "rep", "director": "dir",
    "attendant": "attn", "operative": "oper op", "management": "mgmt", "programmer": "prog", "receptionist": "recep", "security": "sec", "maintenance": "maint",
    "development": "dev", "services": "svcs", "building": "bldg", "laboratory": "lab", "research": "res", "researcher": "res", "public": "pub",
    "relations": "rel", "international": "intl", "department": "dept", "architect": "arch", "designer": "des", "controller": "ctrl", "inventory": "inv",
    "quantity": "qty", "surveyor": "surv", "trade": "trd", "test": "tst", "automation": "auto", "learning": "lrn",
}
ROLE_LEVELS = {
    "senior", "sr", "snr", "junior", "jr", "jnr", "lead", "principal", "graduate", "trainee", "interim", "chief", "apprentice", "intern", "entry", "level",
    "experienced", "temporary", "temp", "permanent", "perm", "freelance", "casual", "acting", "deputy", "parttime", "fulltime", "part", "full", "time",
    "i", "ii", "iii", "iv", "v", "remote", "hybrid", "onsite", "contract", "nights", "days", "mid", "wanted", "urgent", "m", "w", "d", "f", "x", "roles",
}
# Words that stand for any job and must not match one.
_ROLE_CUTS = [
    (re.compile(r"\([^)]*\)?"), " "),
    (re.compile(r"^\s*\S+\s+team\s*:\s*", re.I), " "),
    (re.compile(r"\s*[/|]\s*(?:team|group|shift)\s+(?:lead|leader).*$", re.I), " "),
    (re.compile(r"\bwith\s+(?:car|travel|own|van|driving|licen[cs]e)\b.*$", re.I), " "),
    (re.compile(r"\s+[-–—]\s*(?:nights?|days?|evenings?|weekends?|shifts?|remote|hybrid|contract|fixed[- ]term|maternity cover|temporary|permanent|part[- ]time|full[- ]time|urgent)\b.*$", re.I), " "),
    (re.compile(r",\s*(?:contract|temporary|permanent|remote|hybrid|nights?|part[- ]time|full[- ]time)\s*$", re.I), " "),
    (re.compile(r"\b(?:part|full)[- ]time\b|\bfixed[- ]term\b|\bon[- ]site\b|\bnight shift\b|\bmaternity cover\b|\bstart now\b", re.I), " "),
]


def fold(text: str) -> str:
    """Lower case without accents; ß as ss; everything but letters and digits as single spaces."""
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss"))
    return " ".join(re.sub(r"[^\w]|_", " ", "".join(c for c in text if not unicodedata.combining(c))).split())


def max_distance(length: int) -> int:
    """Errors allowed for a value of so many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 14 else 3


class Trie:
    """Paths of characters to entries; one entry may have many paths."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, entry: int) -> None:
        node = self.root
        for ch in path:
            node = node.setdefault(ch, {})
        node.setdefault("", set()).add(entry)

    def search(self, word: str, k: int) -> dict[int, int]:
        """Least distance of every entry within ``k`` edits of ``word`` (insert, delete, replace, swap of neighbours).

        Bit i of the vector of e errors: i characters of the word are consumed with e errors. A swap
        is a detour of two characters, kept in vectors of its own.
        """
        n = len(word)
        mask: dict[str, int] = {}
        for i, ch in enumerate(word):
            mask[ch] = mask.get(ch, 0) | 1 << i
        full, final = (1 << n + 1) - 1, 1 << n
        start, reach = [], 0
        for e in range(k + 1):
            reach |= 1 << e
            start.append(reach & full)
        found: dict[int, int] = {}
        stack = [(self.root, start, [0] * (k + 1))]
        while stack:
            node, rows, swaps = stack.pop()
            if "" in node:
                for e in range(k + 1):
                    if rows[e] & final:
                        for entry in node[""]:
                            found[entry] = min(e, found.get(entry, e))
                        break
            for ch, child in node.items():
                if not ch:
                    continue
                m = mask.get(ch, 0)
                new, half, before = [], [], 0
                for e in range(k + 1):
                    r = (rows[e] & m) << 1
                    if e:
                        # replace; a letter of the path that the word lacks; a letter of the word that the path lacks
                        r |= rows[e - 1] << 1 | rows[e - 1] | before << 1
                        r |= (swaps[e] & m) << 2
                    r &= full
                    new.append(r)
                    half.append((rows[e - 1] & m >> 1) if e else 0)
                    before = r
                if any(new) or any(half):
                    stack.append((child, new, half))
        return found


def build(entries: list[tuple[int, str]], short: dict[str, str], rotate: bool) -> Trie:
    """A trie of (id, name) entries with alias paths from short forms and, with ``rotate``, the last word first."""
    trie = Trie()
    for entry, name in entries:
        umlauts = name.lower().translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue"}))
        for form in {fold(name), fold(umlauts)}:
            words = form.split()
            paths = {tuple(p) for p in product(*([w, *short.get(w, "").split()] for w in words))} if len(words) <= 6 else {tuple(words)}
            for p in paths:
                trie.add("".join(p), entry)
                if rotate and len(p) > 1:
                    for cut in range(1, len(p)):
                        trie.add("".join(p[cut:] + p[:cut]), entry)
    return trie


def reached(trie: Trie, word: str, everything: bool) -> dict[int, int]:
    """The entries within the distance allowed for the length and their distances; without ``everything`` an exact hit ends the search."""
    hits = {} if everything else trie.search(word, 0)  # most values are typed without an error
    if not hits and (everything or max_distance(len(word))):
        hits = trie.search(word, max_distance(len(word)))
    return hits


#: (entry, distance, rank, fits): the rank is that of the form of the value that reached the entry, nearer ones first; an entry may
#: be reached and yet not fit, as a town in another country than the one named.
Candidate = tuple[int, int, int, bool]
FORMS = 1000  # more forms of a value than there can be


def settled(found: list[Candidate]) -> int:
    """The entry meant: the only one that fits among those of the best rank, or -1."""
    if not found:
        return NONE_MEANT
    best = min(rank for _, _, rank, _ in found)
    ids = {i for i, _, rank, fits in found if rank == best and fits}
    return ids.pop() if len(ids) == 1 else NONE_MEANT


def place_candidates(entries: list[tuple[int, str, str]], everything: bool = False, short: dict = PLACE_SHORT, countries: dict = COUNTRY_NAMES, noise: re.Pattern = PLACE_NOISE) -> Callable[[str], list[Candidate]]:
    """A function from a typed location to its candidates, for (place_id, town, country_code).

    Short forms of words, names of countries and words beside a town are parameters.
    """
    trie = build([(i, town) for i, town, _ in entries], short, rotate=False)
    code_of = {i: code for i, _, code in entries}
    names = {fold(n): code for code, ns in countries.items() for n in ns}

    def find(value: str) -> list[Candidate]:
        code, found = None, []
        parts = [fold(p) for p in re.split(r"[,;/|()\n]|\s[-–—]\s", value)]
        towns = []
        for p in parts:
            if p in names and (len(p) > 1):
                code = names[p]
            elif p:
                towns.append(p)
        at = 0
        for p in towns:
            forms = [p, *([q] if (q := " ".join(noise.sub(" ", re.sub(r"\d+\w?", " ", p)).split())) != p else [])]
            if " " in p and not code:  # "Town Country" without a mark between
                for name, c in names.items():
                    if len(name) > 3 and p.endswith(" " + name):
                        forms.append(p[: -len(name) - 1])
                        code = c
            for f in forms:
                word = f.replace(" ", "")
                at = min(at + 1, FORMS - 1)
                if len(word) < 3 or re.search(r"\b(?:street|road|avenue|lane|strasse|calle)\b", f):
                    continue
                hits = reached(trie, word, everything)
                found += [(i, d, d * FORMS + at, True) for i, d in hits.items()]
        return [(i, d, rank, not code or code_of[i] == code) for i, d, rank, _ in found]

    return find


def role_candidates(entries: list[tuple[int, str]], everything: bool = False, short: dict = ROLE_SHORT, levels: set = ROLE_LEVELS) -> Callable[[str], list[Candidate]]:
    """A function from a typed title to its candidates, for (role_id, role). Short forms and words beside a role are parameters."""
    trie = build(entries, short, rotate=True)

    def find(value: str) -> list[Candidate]:
        text = value
        for pattern, by in _ROLE_CUTS:
            text = pattern.sub(by, text)
        words = fold(text).split()
        bare = list(words)
        while len(bare) > 1 and bare[0] in levels:
            bare.pop(0)
        while len(bare) > 1 and bare[-1] in levels:
            bare.pop()
        forms = [fold(value).split(), words, bare]
        # level words that end up inside when the last word was typed first
        forms.append([w for w in bare if w not in levels] or bare)
        found, seen, at = [], set(), 0
        for ws in forms:
            word = "".join(ws)
            if len(word) < 3 or word in seen:
                continue
            seen.add(word)
            for form in (word, word[:-1]) if word.endswith("s") else (word,):
                at += 1
                for i, d in reached(trie, form, everything).items():
                    d += form != word and d > 0
                    found.append((i, d, d * FORMS + at, True))
        return found

    return find


def place_matcher(entries: list[tuple[int, str, str]], **words) -> Callable[[str], int]:
    """A function from a typed location to a place id or -1, for (place_id, town, country_code)."""
    find = place_candidates(entries, **words)
    return lambda value: settled(find(value))


def role_matcher(entries: list[tuple[int, str]], **words) -> Callable[[str], int]:
    """A function from a typed title to a role id or -1, for (role_id, role)."""
    find = role_candidates(entries, **words)
    return lambda value: settled(find(value))


_BLANK = " \t\r\n\u00a0"
_built: dict[str, Callable] = {}  # of this worker process, by the token of a call


def _once(token: str, make: Callable[[], Callable]) -> Callable:
    """The function of a call, built once in a worker process whatever its number of tasks."""
    if token not in _built:
        while len(_built) >= 8:
            _built.pop(next(iter(_built)))
        _built[token] = make()
    return _built[token]


def _distinct(values: DataFrame, column: str) -> DataFrame:
    """Each non-blank value once; few bytes but much work for each, so as many tasks as cores, where sizes alone would give one."""
    distinct = values.select(F.col(column).alias("value")).where(F.btrim("value", F.lit(_BLANK)) != "").distinct()
    return distinct.repartition(max(2, values.sparkSession.sparkContext.defaultParallelism), "value")


def map_distinct(values: DataFrame, column: str, make: Callable[[list], Callable[[str], int]], entries: list) -> DataFrame:
    """(value, ref_id) for each distinct non-blank text of ``column``; -1 where no entry is meant.

    ``make(entries)`` builds the matcher once in each Python worker. A list of more than ``MAX_ENTRIES`` goes through :func:`mapped`.
    """
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"a reference list of {len(entries)} entries does not fit the trie of a worker; at most {MAX_ENTRIES}")
    token = uuid.uuid4().hex
    shared = values.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator) -> Iterator:
        match = _once(token, lambda: make(shared.value))
        for pdf in batches:
            yield pdf.assign(ref_id=[match(v) for v in pdf["value"]])

    return _distinct(values, column).mapInPandas(run, "value string, ref_id bigint")


def candidate_rows(values: DataFrame, column: str, make: Callable[[list], Callable[[str], list[Candidate]]], pieces: list[list]) -> DataFrame:
    """(value, ref_id, distance, rank, fits): the candidates of each distinct value from all pieces of a list, each piece in a trie of its own."""
    sc, distinct = values.sparkSession.sparkContext, _distinct(values, column)

    def of(piece: list) -> DataFrame:
        token, shared = uuid.uuid4().hex, sc.broadcast(piece)

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            find = _once(token, lambda: make(shared.value))
            for pdf in batches:
                yield pd.DataFrame([(v, *c) for v in pdf["value"] for c in find(v)], columns=["value", "ref_id", "distance", "rank", "fits"])

        return distinct.mapInPandas(run, "value string, ref_id bigint, distance int, rank bigint, fits boolean")

    return reduce(DataFrame.union, [of(p) for p in pieces])


def mapped(values: DataFrame, column: str, candidates: Callable, pieces: list[list]) -> DataFrame:
    """(value, ref_id) as :func:`map_distinct`, for a list in any number of pieces: the same answers as one trie would give."""
    if len(pieces) == 1:
        return map_distinct(values, column, lambda entries: lambda v, find=candidates(entries): settled(find(v)), pieces[0])
    rows = candidate_rows(values, column, candidates, pieces)
    best = rows.groupBy("value").agg(F.min("rank").alias("rank"))
    ids = rows.where("fits").join(best, ["value", "rank"]).groupBy("value").agg(F.min("ref_id").alias("a"), F.max("ref_id").alias("z"))
    one = ids.where("a = z").select("value", F.col("a").alias("ref_id"))
    return _distinct(values, column).join(one, "value", "left").fillna(NONE_MEANT, ["ref_id"])


def in_pieces(entries: DataFrame, most: int = 0) -> list[list[tuple]]:
    """The rows of a reference list in pieces of about ``most`` (``MAX_ENTRIES``), dealt by the hash of the first column."""
    n = -(-entries.count() // (most or MAX_ENTRIES))
    part = F.pmod(F.xxhash64(entries.columns[0]), F.lit(max(n, 1)))
    return [[tuple(r) for r in entries.where(part == i).collect()] for i in range(max(n, 1))]


def _free(rows: DataFrame, column: str, exact: DataFrame) -> DataFrame:
    """Rows whose value is neither NULL or blank nor byte for byte an entry."""
    return rows.where(F.btrim(F.col(column), F.lit(_BLANK)) != "").join(broadcast_small(exact.withColumnRenamed("value", column)), column, "left_anti")


def with_reference(rows: DataFrame, column: str, exact: DataFrame, make, entries: list) -> DataFrame:
    """``rows`` of a value that is typed freely, with ``ref_id``.

    Rows whose value is NULL, blank or byte for byte an entry of ``exact`` (one column ``value``) are
    left out. Repeated rows are each kept. Joined on the value; a value that a third of all rows
    carry is split by adaptive skew handling, since the mapping has one row for each value.
    """
    free = _free(rows, column, exact)
    return free.join(map_distinct(free, column, make, entries).withColumnRenamed("value", column), column)


def _kinds(spark, sf_dir: str) -> list[tuple]:
    """(kind, freely typed rows of rec_id and value, candidates, pieces of the list) of each mapping."""
    places, roles = table(spark, sf_dir, "place_list"), table(spark, sf_dir, "role_list")
    at = table(spark, sf_dir, "job_cache").select(F.col("ord").alias("rec_id"), F.col("location").alias("value"))
    titles = table(spark, sf_dir, "title_groups").select(F.col("group_id").alias("rec_id"), F.col("canonical").alias("value"))
    return [
        ("location", _free(at, "value", places.select(F.col("place").alias("value"))), place_candidates, in_pieces(places.select("place_id", "town", "country_code"))),
        ("title", _free(titles, "value", roles.select(F.col("role").alias("value"))), role_candidates, in_pieces(roles.select("role_id", "role"))),
    ]


def p2_found(spark, sf_dir: str) -> DataFrame:
    """(kind, rec_id, ref_id): the place or role meant by each freely typed location and title, -1 for none."""
    out = [rows.join(mapped(rows, "value", find, pieces), "value").select(F.lit(kind).alias("kind"), "rec_id", "ref_id") for kind, rows, find, pieces in _kinds(spark, sf_dir)]
    return reduce(DataFrame.unionByName, out)


def _everything(rows: DataFrame, find, pieces) -> DataFrame:
    """(value, ref_id, distance, fits): every entry within the distance allowed for a value, at its least distance."""
    found = candidate_rows(rows, "value", partial(find, everything=True), pieces)
    return found.groupBy("value", "ref_id").agg(F.min("distance").alias("distance"), F.max("fits").alias("fits"))


def p2_candidates(spark, sf_dir: str) -> DataFrame:
    """(kind, rec_id, ref_id, distance, fits, chosen): all entries within the distance allowed for each value; ``fits`` is false for a town
    outside the country named, ``chosen`` marks the entry of :func:`p2_found`. Values with several fitting entries and none chosen are ties."""
    out = []
    for kind, rows, find, pieces in _kinds(spark, sf_dir):
        every = _everything(rows, find, pieces).join(mapped(rows, "value", find, pieces).withColumnRenamed("ref_id", "__meant"), "value")
        out.append(rows.join(every, "value").select(F.lit(kind).alias("kind"), "rec_id", "ref_id", "distance", "fits", (F.col("ref_id") == F.col("__meant")).alias("chosen")))
    return reduce(DataFrame.unionByName, out)


def p2_unmatched(spark, sf_dir: str) -> DataFrame:
    """(kind, value, n_rows, why): the values without an entry, how often each is typed, and why: 'tie' of several entries, 'elsewhere' for
    towns outside the country named, 'unknown' where nothing is near."""
    out = []
    for kind, rows, find, pieces in _kinds(spark, sf_dir):
        none = mapped(rows, "value", find, pieces).where(F.col("ref_id") == NONE_MEANT).select("value")
        near = _everything(rows, find, pieces).groupBy("value").agg(F.max("fits").alias("fits"))
        why = F.when(F.col("fits"), "tie").when(F.col("fits").isNotNull(), "elsewhere").otherwise("unknown")
        counts = rows.groupBy("value").agg(F.count("*").alias("n_rows"))
        out.append(none.join(near, "value", "left").join(counts, "value").select(F.lit(kind).alias("kind"), "value", "n_rows", why.alias("why")))
    return reduce(DataFrame.unionByName, out)
