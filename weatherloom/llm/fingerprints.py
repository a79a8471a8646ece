"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraphs.

A text is the set of its paragraphs (lines that are not empty), each with the number of times it
occurs, as 64-bit keys. A sketch has CELLS cells; each key is put into one cell of each third of
them, where a cell keeps the number of its keys, the xor of the keys and the xor of their checks.

Two sketches of the same size are subtracted cell by cell, which leaves the keys that only one text
has. Peeling recovers them: a cell whose count is 1 or -1 and whose check fits holds a single key,
which is taken out of its other cells, until all cells are empty. If some are left, the sketch was
too small and a larger one is made. Past the sizes in GROWN, keys are dealt to several sketches, so
that the work stays in proportion to the number of paragraphs however many there are.

All of it is column expressions: no Python runs on the executors.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import written

# The published sketch; a multiple of 3.
CELLS = 24
# Sizes to retry with while all keys of a pair fit one sketch, which three quarters of its cells do.
GROWN = (60,)
# A sketch that keys are dealt to gets about this many of them, and half as many in each retry.
DEALT_KEYS = 16
# Rounds of peeling; each takes out all keys that stand alone.
ROUNDS = 12
# Ids are neighbours within groups of 2 ** GROUP_BITS; see previous_groups.
GROUP_BITS = 12
# Groups with more rows than this, by repeated ids, are cut; see with_next_text.
CROWDED_ROWS = 4 << GROUP_BITS


# The expressions below are SQL text: nested functions of arrays, whose names must differ by level.


def _let(value: str, name: str, body: str) -> str:
    """`body`, in which `name` stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


# --- sketches ------------------------------------------------------------------------------------


def paragraph_keys(text: str) -> Column:
    """Keys of the paragraphs of a text: one for each different line and its number of occurrences."""
    hashes = f"""array_sort(transform(
        filter(split({text}, '\n'), line -> trim(line) <> ''), line -> xxhash64('paragraph', line)))"""
    # Places where a new hash begins, and the end.
    firsts = """filter(sequence(0, size(found)), i ->
        i = 0 OR i = size(found) OR get(found, i) <> get(found, i - 1))"""
    keys = """transform(slice(begins, 1, size(begins) - 1), (begin, j) ->
        xxhash64(get(found, begin), get(begins, j + 1) - begin))"""
    some = _let(firsts, "begins", keys)
    none = "cast(array() AS array<bigint>)"
    return F.expr(_let(hashes, "found", f"IF(size(found) = 0, {none}, {some})"))


def _check(key: str) -> str:
    return f"xxhash64('check', {key}) & 4294967295"


def _placed(key: str, cells: int, seed: int) -> str:
    """A key with its check and its cell in each third."""
    third = cells // 3
    places = [
        f"""'p{i}', cast(pmod(shiftrightunsigned(xxhash64({seed}, {key}), {21 * i}) & 2097151,
        {third}) + {i * third} AS int)"""
        for i in range(3)
    ]
    return f"named_struct('k', {key}, 'c', {_check(key)}, {', '.join(places)})"


def sketch(keys: str, cells: int = CELLS, seed: int = 0) -> str:
    """Cells (n, k, c) of a set of keys. Equal sets have equal sketches."""
    third = cells // 3
    thirds = [
        f"""transform(sequence({i * third}, {(i + 1) * third - 1}), cell -> aggregate(placed,
          named_struct('n', 0, 'k', 0L, 'c', 0L),
          (sums, key) -> IF(key.p{i} = cell,
            named_struct('n', sums.n + 1, 'k', sums.k ^ key.k, 'c', sums.c ^ key.c), sums)))"""
        for i in range(3)
    ]
    placed = f"transform({keys}, key -> {_placed('key', cells, seed)})"
    return _let(placed, "placed", f"concat({', '.join(thirds)})")


def subtract(left: str, right: str) -> str:
    """Cells of the keys that only one of two sketches has."""
    return f"""zip_with({left}, {right}, (a, b) ->
        named_struct('n', a.n - b.n, 'k', a.k ^ b.k, 'c', a.c ^ b.c))"""


def peel(difference: str, cells: int = CELLS, seed: int = 0) -> str:
    """struct(only_left, only_right, complete): the keys recovered from a difference."""
    alone = f"""array_distinct(transform(
        filter(state.cells, cell -> abs(cell.n) = 1 AND cell.c = ({_check('cell.k')})),
        cell -> named_struct('n', cell.n, 'at', {_placed('cell.k', cells, seed)})))"""
    rest = """transform(state.cells, (cell, i) -> aggregate(taken, cell, (sums, key) ->
        IF(key.at.p0 = i OR key.at.p1 = i OR key.at.p2 = i,
          named_struct('n', sums.n - key.n, 'k', sums.k ^ key.at.k, 'c', sums.c ^ key.at.c), sums)))"""
    found = "concat(state.found, transform(taken, key -> named_struct('n', key.n, 'k', key.at.k)))"
    after = f"IF(size(taken) = 0, state, named_struct('cells', {rest}, 'found', {found}))"
    sides = [
        f"'{name}', transform(filter(state.found, f -> f.n = {n}), f -> f.k)"
        for name, n in (("only_left", 1), ("only_right", -1))
    ]
    return f"""aggregate(sequence(1, {ROUNDS}),
        named_struct('cells', {difference},
          'found', cast(array() AS array<struct<n: int, k: bigint>>)),
        (state, _) -> {_let(alone, 'taken', after)},
        state -> named_struct({', '.join(sides)},
          'complete', forall(state.cells, c -> c.n = 0 AND c.k = 0 AND c.c = 0)))"""


def difference(left_keys: str, right_keys: str, cells: int, seed: int = 0) -> str:
    """What `peel` recovers of two sets of keys through sketches of this size."""
    both = subtract(sketch(left_keys, cells, seed), sketch(right_keys, cells, seed))
    return peel(both, cells, seed)


def sketch_text(cells: str) -> Column:
    """A sketch as text; empty cells are empty."""
    return F.expr(f"""array_join(transform({cells}, cell -> IF(cell.n = 0, '', concat_ws(':',
        hex(cast(cell.n AS bigint)), lpad(hex(cell.k), 16, '0'), lpad(hex(cell.c), 8, '0')))), ',')""")


# --- differences of any size ---------------------------------------------------------------------


def key_differences(pairs: DataFrame) -> DataFrame:
    """(pair, n_left, n_right): how many keys only the left and only the right side of a pair has.

    `pairs` has pair (unique), left and right, arrays of keys. A pair's keys are dealt to sketches of
    CELLS cells by another hash than the cells'; each sketch is peeled on its own, and one that fails
    is dealt to four new ones. Each round handles only what failed, and writes to scratch.
    """
    sides = pairs.select(
        "pair",
        F.lit(0).cast("bigint").alias("part"),
        F.greatest(F.ceil((F.size("left") + F.size("right")) / DEALT_KEYS), F.lit(1)).alias("n"),
        F.expr("""explode(concat(transform(left, k -> named_struct('side', 1, 'k', k)),
            transform(right, k -> named_struct('side', -1, 'k', k))))""").alias("key"),
    )
    done, seed = [], 1
    while True:
        dealt = sides.select(
            "pair",
            (
                F.col("part") * F.col("n")
                + F.pmod(F.xxhash64(F.lit("deal"), F.lit(seed), "key.k"), F.col("n"))
            ).alias("part"),
            "key",
        )
        groups = dealt.groupBy("pair", "part").agg(F.collect_list("key").alias("keys"))

        def side(n):
            return f"transform(filter(keys, k -> k.side = {n}), k -> k.k)"

        found = groups.withColumn("found", F.expr(difference(side(1), side(-1), CELLS, seed)))
        found = found.select(
            "pair",
            "part",
            F.size("found.only_left").alias("n_left"),
            F.size("found.only_right").alias("n_right"),
            F.when(~F.col("found.complete"), F.col("keys")).alias("keys"),
        )
        found = written(found, "peeled")
        done.append(found.where("keys IS NULL").select("pair", "n_left", "n_right"))
        failed = found.where("keys IS NOT NULL")
        if failed.isEmpty():
            break
        sides = failed.select(
            "pair", "part", F.lit(4).cast("bigint").alias("n"), F.explode("keys").alias("key")
        )
        seed += 1
    total = done[0]
    for more in done[1:]:
        total = total.union(more)
    sums = [F.sum(c).alias(c) for c in ("n_left", "n_right")]
    return written(total.groupBy("pair").agg(*sums), "key-differences")


def likeness(n_left: str, n_right: str, sizes: str) -> str:
    """Shared keys among all keys of two texts, from the keys that only one has; 1 if both are empty.

    `sizes`: number of keys of both texts together.
    """
    apart = f"({n_left} + {n_right})"
    return f"IF({sizes} = 0, 1.0D, cast({sizes} - {apart} AS double) / nullif({sizes} + {apart}, 0))"


# --- the next document ---------------------------------------------------------------------------


def previous_groups(groups: DataFrame, low: int, high: int) -> DataFrame:
    """(g, previous): the largest smaller g of a table of distinct numbers g between `low` and `high`.

    The smallest has none. Numbers are neighbours within groups of 2 ** GROUP_BITS values, and the
    first of a group follows the last of the group before, which is found the same way among groups.
    No group has more than 2 ** GROUP_BITS rows, however many there are in all.
    """
    if high - low < 1 << GROUP_BITS:
        all_of_them = Window.partitionBy(F.lit(0)).orderBy("g")
        return groups.select("g", F.lag("g").over(all_of_them).alias("previous"))
    upper = groups.withColumn("upper", F.shiftright("g", GROUP_BITS))
    within = Window.partitionBy("upper").orderBy("g")
    lasts = written(upper.groupBy("upper").agg(F.max("g").alias("last")), "last-groups")
    before = previous_groups(
        lasts.select(F.col("upper").alias("g")), low >> GROUP_BITS, high >> GROUP_BITS
    )
    carried = before.join(
        lasts.select(F.col("upper").alias("previous"), F.col("last").alias("carried")), "previous"
    ).select(F.col("g").alias("upper"), "carried")
    return (
        upper.withColumn("within", F.lag("g").over(within))
        .join(carried, "upper", "left")
        .select("g", F.coalesce("within", "carried").alias("previous"))
    )


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows of crowded groups, in parts: `place` numbers them in order, 2 ** GROUP_BITS to a `part`.

    Copies are told apart by their row, so the copies of one text are spread as well. Rows are written
    before they are ordered and again when sorted, so that tasks run anew give the same numbers.
    """
    order = ("id", "hash", "length", "row")
    keyed = rows.withColumns(
        {
            "hash": F.xxhash64("text"),
            "length": F.length("text"),
            "row": F.monotonically_increasing_id(),
        }
    )
    ranges = (
        written(keyed, "crowded-texts")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .drop("hash", "length", "row")
    )
    return written(ranges, "crowded-rows").withColumn("part", F.shiftright("place", GROUP_BITS))


def _followed_parts(parts: DataFrame) -> DataFrame:
    """(from_g, from_place, g, part): which row of the same group each part but the first follows.

    `parts` has g, part and the last place. A part may hold the end of one group and the beginning
    of another; where a group has the part before, it has all of its last rows.
    """
    numbers = parts.select(F.col("part").alias("g")).distinct()
    before = previous_groups(numbers, *parts.agg(F.min("part"), F.max("part")).first())
    ends = parts.select("g", F.col("part").alias("previous"), F.col("last").alias("from_place"))
    return (
        parts.select("g", "part")
        .join(before.withColumnRenamed("g", "part"), "part")
        .join(ends, ["g", "previous"])
        .select(F.col("g").alias("from_g"), "from_place", "g", "part")
    )


def with_next_text(documents: DataFrame, crowded_rows: int = CROWDED_ROWS) -> DataFrame:
    """doc_id, text and `next_text`, the text of the next document in descending order of doc_id.

    After the last comes the first. Rows that repeat an id follow each other in order of their
    text's hash; a missing id is smaller than any. Texts move once, into groups of neighbouring ids,
    which the last document of the group before joins. A group of more than `crowded_rows` rows, as
    repeated or missing ids make, is first sorted by range partitions and cut into parts, so no
    window holds more than that. Runs small jobs on the ids.
    """
    rows = documents.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("g", F.shiftright("id", GROUP_BITS))
    sizes = rows.groupBy("g").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    sizes = written(sizes, "id-groups")
    low, high = sizes.agg(F.min("g"), F.max("g")).first()
    if low is None:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    # A row's place orders it in its group: its id, or its number in a crowded group.
    whole, crowded = F.lit(-1).cast("bigint"), F.col("n") > crowded_rows
    columns = ("doc_id", "text", "g", "part", "place")
    placed = rows.withColumns({"part": whole, "place": F.col("id")}).select(*columns)
    parts = sizes.select("g", whole.alias("part"), "last")
    followed = None
    if not sizes.where(crowded).isEmpty():
        many = sizes.where(crowded).select("g")
        cut = _crowded(rows.join(many, "g", "left_semi")).select(*columns)
        placed = placed.join(many, "g", "left_anti").select(*columns).union(cut)
        cut_parts = cut.groupBy("g", "part").agg(F.max("place").alias("last"))
        cut_parts = written(cut_parts, "crowded-parts")
        parts = parts.join(many, "g", "left_anti").union(cut_parts)
        followed = _followed_parts(cut_parts)
    # The smallest document is followed by the largest.
    before = previous_groups(sizes.select("g"), low, high).select(
        "g", F.coalesce("previous", F.lit(high)).alias("from_g")
    )
    ends = parts.groupBy("g").agg(F.max("last").alias("from_place"), F.min("part").alias("part"))
    carried = (
        before.join(ends.select("g", "part"), "g")
        .join(ends.select(F.col("g").alias("from_g"), "from_place"), "from_g")
        .select("from_g", "from_place", "g", "part")
    )
    carried = carried.union(followed) if followed else carried
    # A row per group of ids, some thousandth of the documents: with its size known, Spark sends it
    # to the texts while it is small, and moves both sides when it is not.
    carried = written(carried, "carried-rows").select(
        "from_g", "from_place", F.col("g").alias("to_g"), F.col("part").alias("to_part")
    )
    is_last = (F.col("g") == F.col("from_g")) & (F.col("place") == F.col("from_place"))
    extra = placed.join(carried, is_last).select(
        "doc_id",
        "text",
        F.col("to_g").alias("g"),
        F.col("to_part").alias("part"),
        "place",
        F.lit(True).alias("carried"),
    )
    both = placed.withColumn("carried", F.lit(False)).union(extra)
    ordered = Window.partitionBy("g", "part").orderBy(
        F.desc("carried"), "place", F.xxhash64("text"), F.length("text")
    )
    return (
        both.withColumn("next_text", F.lag("text").over(ordered))
        .where(~F.col("carried"))
        .select("doc_id", "text", "next_text")
    )


# --- the operator --------------------------------------------------------------------------------


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the characters replaced by as many first ones of the next text, or all."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half)
    )


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    A missing text is empty. Every input row gives one row, other columns are not looked at. The
    fingerprint is the sketch of CELLS cells; likeness is that of the sets of paragraphs, recovered
    from sketches that grow until they can be peeled. Runs jobs at once and writes to scratch. Sketches
    are made where the texts meet, in tasks as even as the texts.
    """
    texts = with_next_text(documents)
    keyed = texts.select(
        "doc_id", "text", "next_text", edited(F.col("text"), F.col("next_text")).alias("edited")
    ).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_keys("text").alias("own"),
        paragraph_keys("edited").alias("edited"),
        paragraph_keys("next_text").alias("next"),
    )
    other = {"near_edited": "edited", "near_next": "next"}

    def closeness(found, keys):
        sizes = f"(size(own) + size({keys}))"
        near = likeness("size(found.only_left)", "size(found.only_right)", sizes)
        return F.expr(_let(found, "found", f"IF(found.complete, {near}, NULL)"))

    result = keyed.select(
        "*", *[F.expr(sketch(k)).alias(f"{k}_cells") for k in ("own", "edited", "next")]
    )
    result = result.select(
        *keyed.columns,
        sketch_text("own_cells").alias("fingerprint"),
        sketch_text("edited_cells").alias("edited_fingerprint"),
        *[
            closeness(peel(subtract("own_cells", f"{keys}_cells")), keys).alias(name)
            for name, keys in other.items()
        ],
    )
    for cells in GROWN:

        def retried(name, keys):
            small = F.size("own") + F.size(keys) <= cells * 3 // 4
            again = closeness(difference("own", keys, cells), keys)
            # A pair with more keys is not worth this size.
            return F.when(F.col(name).isNull() & small, again).otherwise(F.col(name))

        result = result.withColumns({name: retried(name, keys) for name, keys in other.items()})
    result = written(result, "likeness")
    # Both pairs of a row that are left go on together, told apart by the last bit.
    left = [
        result.where(F.col(name).isNull()).select(
            (2 * F.col("row") + i).alias("pair"), F.col("own").alias("left"), F.col(keys).alias("right")
        )
        for i, (name, keys) in enumerate(other.items())
    ]
    apart = key_differences(left[0].union(left[1]))
    sizes = [(F.size("own") + F.size(keys)).alias(f"{keys}_size") for keys in other.values()]
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *other]
    is_open = F.lit(False)
    for name in other:
        is_open = is_open | F.col(name).isNull()
    # Only rows with a pair that was left meet the differences, and without their keys.
    rest = result.where(is_open).select("row", *columns, *sizes)
    for i, (name, keys) in enumerate(other.items()):
        own = apart.where(F.col("pair") % 2 == i).select(
            F.shiftright("pair", 1).alias("row"), "n_left", "n_right"
        )
        near = F.expr(likeness("n_left", "n_right", f"{keys}_size"))
        rest = rest.join(own, "row", "left").withColumn(name, F.coalesce(F.col(name), near))
        rest = rest.drop("n_left", "n_right")
    return result.where(~is_open).select(*columns).union(rest.select(*columns))
