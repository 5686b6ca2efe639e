"""The language, construct by construct: types, values, messages, the library, and tables that become plans."""

import pytest

from cairn.lang.interpreter import Session


def shown(program: str, stdlib: bool = False) -> list[str]:
    return Session(stdlib=stdlib).run(program)


# -- expressions and their display ------------------------------------------------------------

VALUES = {
    # arithmetic binds as usual; division and remainder truncate
    "7 + 2 * 5 - 4": "13",
    "(7 + 2) * (5 - 4)": "9",
    "17 / 5 + 17 mod 5": "5",
    "(0 - 17) / 5": "-3",
    "(0 - 17) mod 5": "-2",
    "add (mult 6 7) zero": "42",
    # comparison and logic
    "3 * 3 > 8 and not (2 >= 3)": "true",
    "5 < 5 or 5 <= 5": "true",
    # text
    '"rain" ++ "/" ++ "snow"': '"rain/snow"',
    '"tab\\tquote\\""': '"tab\\tquote\\""',
    '"日本, café"': '"日本, café"',
    # pairs nest to the right
    "(1, (2, 3))": "(1, 2, 3)",
    "snd (snd (true, \"mid\", 9))": "9",
    "(((a, b), c) -> a + b * c) ((2, 3), 4)": "14",
    # records: the last of equal names counts, all are shown
    "{ low = 3, high = 11 }": "{low = 3, high = 11}",
    "{ low = 3, high = 11 }.high": "11",
    "(.deep) { wide = 1, deep = { x = 8 } }": "{x = 8}",
    "({ t = 1 } with { t = 2 }).t": "2",
    "{ t = 1 } with { t = 2, u = 3 }": "{t = 1, t = 2, u = 3}",
    "{}": "()",
    # functions
    "(u -> v -> u * 10 + v) 4 2": "42",
    "(() -> 6) ()": "6",
    "if 2 > 1 then 10 else 20 + 5": "10",
    "(if 1 > 2 then 10 else 20) + 5": "25",
    # sums
    "case Cold(4) of { Hot(t) -> t * 100, Cold(t) -> t - 10 }": "-6",
    "case Hot(4) of { Hot(t) -> t * 100, Cold(t) -> t - 10 }": "400",
    'case Dry(()) of { Dry(_) -> "a", Dry(_) -> "b" }': '"a"',
    # lists and the operator that is put between
    "[[3], [], [1, 2]]": "[[3], [], [1, 2]]",
    "seq * (2, 3, 7)": "42",
    "seq append ([1], [], [4, 5])": "[1, 4, 5]",
    # comprehensions
    "(day in (range 3 5)) [{}]": "[{day = 3}, {day = 4}, {day = 5}]",
    "((k, v) in [(7, true)]) [{}]": "[{k = 7, v = true}]",
    # shapes
    ":[(String, [Bool])]": "Shape([(String, [Bool])])",
    ":{ at: Int, by: { name: String } }": "Shape({ at:Int, by:{ name:String } })",
}


@pytest.mark.parametrize("program", VALUES)
def test_values(program):
    assert shown(program) == [VALUES[program]]


SERIES = {
    "range 4 7": "[4, 5, 6, 7]",
    "range 7 4": "[]",
    "times 2 true": "[true, true]",
    "iterate 4 (mult 3) 2": "[2, 6, 18, 54]",
    "bounded_generator 1 (n -> (n * 2, n + 100)) (n -> n > 8)": "[101, 102, 104, 108]",
    "take 3 (generator (1, 1) ((a, b) -> ((b, a + b), a)))": "[1, 1, 2]",
    "map (n -> n * n) (filter (n -> n mod 2 > 0) (range 1 6))": "[1, 9, 25]",
    "flat_map (n -> times n n) (range 1 3)": "[1, 2, 2, 3, 3, 3]",
    "unnest (range 1) [2, 1]": "[(1, 2), (2, 2), (1, 1)]",
    "concat [[5], [6, 7], []]": "[5, 6, 7]",
    "drop 2 (take 4 (range 10 90))": "[12, 13]",
    "take_while (n -> n mod 4 > 0) (range 5 20)": "[5, 6, 7]",
    "drop_while (n -> n mod 4 > 0) [5, 6, 8, 1]": "[8, 1]",
    "take_first (range 6 9)": "[6]",
    "take_last (range 6 9)": "[9]",
    "dedupe [4, 4, 5, 4, 4]": "[4, 5, 4]",
    "unique [4, 4, 5, 4, 4]": "[4, 5]",
    "interpose (0 - 1) [6]": "[6]",
    "interpose (0 - 1) [6, 7, 8]": "[6, -1, 7, -1, 8]",
    "before_each 0 [6, 7]": "[0, 6, 0, 7]",
    "after_each 0 [6, 7]": "[6, 0, 7, 0]",
    "cons 1 (sonc [2] 3)": "[1, 2, 3]",
    "rolling (monoid 1 (*)) [2, 3, 4]": "[2, 6, 24]",
    "transduce 0 (x -> s -> (s + x, if x > 2 then [s] else [])) (s -> [s]) [1, 5, 2, 3]": "[1, 8, 11]",
    'string_split "[;|]" "a;b||c"': '["a", "b", "", "c"]',
    'string_split ";" ";a;"': '["a"]',
    'string_extract "[0-9]+" "x12y3"': '["12", "3"]',
    # reducers: known ones, folds, filters, products, groups
    "reduce (monoid 0 (+)) (range 1 9)": "45",
    "reduce (filtering (n -> n > 3) (monoid 0 (+))) (range 1 5)": "9",
    "reduce (mapping (n -> n * 2) (project (t -> t + 1) (monoid 0 (+)))) [1, 2]": "7",
    "reduce (flat_mapping (range 1) (monoid 0 (+))) [3, 2]": "9",
    "reduce (unnesting (range 1) (mapping (p -> fst p * snd p) (monoid 0 (+)))) [3, 2]": "24",
    "reduce (union_reducer (monoid 0 (+))) [[1], [2, 3], []]": "6",
    "reduce (product_reducer (monoid 0 (+)) (monoid true (and))) [(1, true), (2, false)]": "(3, false)",
    "pairs (reduce (group_reducer (n -> n mod 2) (n -> n) (monoid 0 (+))) (range 1 5))": "[(1, 9), (0, 6)]",
    "reduce (monoid_with_maximum_check 0 (+) (n -> n >= 10)) (generator 1 (n -> (n + 1, n)))": "10",
    "reduce (first_or 5) []": "5",
    "reduce (last_or 5) [6, 7]": "7",
    "reduce (top (n -> n mod 3) (n -> n) 2) [4, 8, 1, 5, 9]": "[9, 8]",
}


@pytest.mark.parametrize("program", SERIES)
def test_series(program):
    assert shown(program) == [SERIES[program]]


def test_several_results():
    assert shown("reduce first [8, 9], reduce last [8, 9], reduce first []") == ["[8]", "[9]", "[]"]
    assert shown("low = 3\nhigh = low + 4, high * 2") == ["low = 3", "high = 7", "14"]


# -- types ------------------------------------------------------------------------------------------

# How types are displayed.
TYPES = {
    "n -> n + 1": "Int -> Int",
    "(f -> g -> x -> f (g x))": "forall a, b, c. (a -> b) -> (c -> a) -> c -> b",
    "((x, y) -> y)": "forall a, b. (a, b) -> b",
    "(r -> r.start + r.length)": "forall a with { start:Int, length:Int, ... }. a -> Int",
    "(r -> r with { seen = true })": "forall a with { ... }. a -> a with { seen:Bool }",
    "(.owner)": "forall a with { owner:b, ... }, b. a -> b",
    "cases { On(v) -> v + 1, Off(_) -> 0 }": "forall a. either { On(Int), Off(a) } -> Int",
    "monoid_with_maximum": "forall a. a -> (a -> a -> a) -> a -> Reducer(a, a, a)",
}


@pytest.mark.parametrize("program", TYPES)
def test_types(program):
    assert shown(program) == [TYPES[program]]


def test_definitions_show_name_and_type():
    assert shown("half n = n / 2, half 9") == ["half : Int -> Int", "4"]
    assert shown("!infix_left 6 +++, a +++ b = a * 10 + b, 1 +++ 2 +++ 3") == ["+++ : Int -> Int -> Int", "123"]
    assert shown("!infix_right 6 +++, a +++ b = a * 10 + b, 1 +++ 2 +++ 3") == ["+++ : Int -> Int -> Int", "33"]
    assert shown("both = x -> (x, x), both 1, both \"b\"") == ["both : forall a. a -> (a, a)", "(1, 1)", '("b", "b")']
    assert shown("tool = { twice(f) = x -> f (f x), name = \"t\" }, tool.twice (mult 5) 2")[-1] == "50"
    assert shown("first_seen = 4\nfirst_seen = 5\nfirst_seen") == ["first_seen = 4", "first_seen = 5", "5"]


# -- messages -----------------------------------------------------------------------------------------

# Messages.
MESSAGES = {
    "missing_name + 1": "ERROR: unknown value 'missing_name'",
    'mult 3 "four"': "TYPE ERROR: incompatible types 'Int' and 'String'",
    "loop f = f(f)": "TYPE ERROR: incompatible types 'a' and 'a -> b'",
    "{ width = 2 }.height": "TYPE ERROR: missing fields { height:a }",
    "if 1 then 2 else 3": "TYPE ERROR: incompatible types 'Bool' and 'Int'",
    'seq ++ ("a", 2)': "TYPE ERROR: incompatible types 'String' and 'Int'",
    ":{ at: Date }": "TYPE ERROR: unknown type 'Date'",
    "cases { A(n) -> n + 1, B(n) -> n > 1 }": "TYPE ERROR: incompatible types 'Int' and 'Bool'",
}


@pytest.mark.parametrize("program", MESSAGES)
def test_messages(program):
    assert shown(program)[-1] == MESSAGES[program]


def test_integers_have_64_bits():
    assert shown("9223372036854775806 + 1") == ["9223372036854775807"]
    for program in ("9223372036854775807 + 1", "3037000500 * 3037000500", "0 - 9223372036854775807 - 2"):
        with pytest.raises(OverflowError):
            shown(program)


# -- codecs ---------------------------------------------------------------------------------------------

SHAPES = {":Int": "40", ":String": '"a\\"b"', ":Bool": "true", ":()": "()", ":(Bool,Int,String)": '(false, 6, "six")', ":{ id:Int, ok:Bool }": "{ id = 5, ok=true }", ":[(Int,String)]": '[(1, "one"), (2, "two")]', ":[[Bool]]": "[[true],[],[false]]", ":{ grid: [[Int]], of: { who:String }}": '{ grid = [[1],[2,3]], of = { who = "us" }}'}


@pytest.mark.parametrize("fmt", ["json", "marshal"])
@pytest.mark.parametrize("shape", SHAPES)
def test_what_is_encoded_is_decoded(fmt, shape):
    s = Session()
    (want,) = s.run(f"[{SHAPES[shape]}]")
    assert s.run(f"flat_map ({fmt}_decode {shape}) ({fmt}_encode {shape} {SHAPES[shape]})") == [want]


@pytest.mark.parametrize(
    "shape, text, want",
    [
        (":{ n: Int, who: String }", '{who:"me", n:4, extra:[1]}', '[{n = 4, who = "me"}]'),
        (":{ n: Int }", '{"n":1,"n":2}', "[{n = 1}]"),
        (":{ n: Int }", '{"m":1}', "[]"),
        (":Int", '"12"', "[12]"),
        (":Int", "1.5", "[]"),
        (":Bool", '"false"', "[false]"),
        (":(Int,Bool)", "[3,true]", "[(3, true)]"),
        (":(Int,Bool)", "[3]", "[]"),
        (":()", "null", "[()]"),
        (":String", "no json", "[]"),
    ],
)
def test_decoding(shape, text, want):
    quoted = text.replace('"', '\\"')
    assert shown(f'json_decode {shape} "{quoted}"') == [want]


# -- the library ---------------------------------------------------------------------------------------------

LIBRARY = {
    "2 .. 5": "[2, 3, 4, 5]",
    "2 ..< 5": "[2, 3, 4]",
    "2 <.. 5": "[3, 4, 5]",
    "2 <..< 5": "[3, 4]",
    "3 ** 4": "81",
    "3 ** 0": "1",
    "5 |> add 1 |> mult 2": "12",
    "(mult 2 << add 1) 5": "12",
    "(mult 2 >> add 1) 5": "11",
    "dup <| swap (1, 2)": "((2, 1), 2, 1)",
    "flip pair 1 2": "(2, 1)",
    "curry fst 1 2 + uncurry add (3, 4)": "8",
    "pair_with (mult 3) 4": "(12, 4)",
    "constant id 9 8": "8",
    "forall (gt 2) [3, 4]": "true",
    "exists (le 2) [3, 4]": "false",
    "is_empty (range 2 1)": "true",
    "at_least 2 integers": "true",
    "at_most 2 (range 1 3)": "false",
    "reduce bag [2, 2, 1]": "[2, 2, 1]",
    "reduce set [2, 2, 1]": "[2, 1]",
    "reduce set_union [[2], [1, 2]]": "[2, 1]",
    "reduce bag_union [[2], [1, 2]]": "[2, 1, 2]",
    "reduce (count_at_most 3) integers": "3",
    "union [1, 2] [2, 3]": "[1, 2, 3]",
    "[1, 2] & [2]": "[1, 2, 2]",
    "remove (lt 0) [1, 0 - 1]": "[1]",
    "decorate 7 8 []": "[7, 8]",
    "cross_product [1, 2] [true]": "[(1, true), (2, true)]",
    "map_cross_product add [1, 2] [10, 20]": "[11, 12, 21, 22]",
    "power_set [3, 4]": "[[], [3], [4], [3, 4]]",
    "power_set [6, 6]": "[[], [6], [6], [6]]",
    "window_of 2 [7, 8, 9]": "[[7, 8], [8, 9]]",
    "window_of 4 [7, 8, 9]": "[]",
    "pairs (partition (gt 5) [4, 6, 7])": "[(false, [4]), (true, [6, 7])]",
    "pairs (cogroup fst snd fst snd [(1, 5)] [(2, 6), (1, 7)])": "[(1, [5], [7]), (2, [], [6])]",
    "pairs (tumbling_window { size = 10, offset = 1 } id count [1, 10, 11, 30])": "[(0, 2), (1, 1), (2, 1)]",
    "get_tumbling_window { size = 10, offset = 0 } (0 - 5)": "0",
    "get_sliding_windows { size = 6, slide = 3, offset = 0 } 7": "[2, 1, 0]",
    "pairs (sliding_windows { size = 6, slide = 3, offset = 0 } id sum [7, 2])": "[(2, 7), (1, 7), (0, 9), (-1, 2), (-2, 2)]",
    "take 4 (iterate 1 (mult 2))": "[1, 2, 4, 8]",
    "take 2 (series 1 (mult 2))": "[2, 4]",
    "transduce { seed = 1, step x s = (s * x, [s]), term s = [s] } [2, 3]": "[1, 2, 6]",
    'string_words "2 ants, 3 bees"': '["ants", "bees"]',
    '(encoding json :Int).decode "4"': "[4]",
    "json.print (1, true)": '["(1,true)"]',
    "(1, \"a\") == (1, \"a\")": "true",
    "[1] != [1, 1]": "true",
}


@pytest.mark.parametrize("program", LIBRARY)
def test_library(program):
    assert shown(program, stdlib=True) == [LIBRARY[program]]


def test_changelog_of_groups():
    program = 'moves = group_updates fst snd (last_or 0) ((k, v) -> k ++ "+") ((k, v) -> k ++ "-")\nmoves [("a", 1), ("b", 0), ("a", 1), ("a", 2), ("b", 3)]'
    assert shown(program)[-1] == '["a+", "a-", "a+", "b+"]'


# -- tables ---------------------------------------------------------------------------------------------------


def test_tables_become_plans(spark):
    s = Session(stdlib=True)
    s.table("visits", spark.createDataFrame([(i, i % 3, f"r{i % 2}") for i in range(1, 11)], "at int, guest long, room string"), "at")
    assert s.run("reduce sum (map (v -> v.at * 2) (filter (v -> v.guest == 1) visits))") == ["44"]
    assert s.run("take 2 (map (v -> (v.room, v.at + 1)) visits)") == ['[("r1", 2), ("r0", 3)]']
    plan = s.value("map (v -> { twice = v.at * 2 }) (filter (v -> v.at > 3) visits)")
    assert [r.item.twice for r in plan.df.orderBy("_pos").collect()] == [8, 10, 12, 14, 16, 18, 20]
    assert sorted(map(tuple, s.value("group (v -> v.guest) (v -> v.at) sum visits").pairs().collect())) == [(0, 18), (1, 22), (2, 15)]
    assert s.run("flat_map (v -> range 1 v.guest) (take 3 visits)") == ["[1, 1, 2]"]
    assert s.run("reduce (top (v -> v.guest) (v -> v.at) 2) visits |> map (v -> v.at)") == ["[10, 9]"]
    assert s.run("map (.at) (reduce first visits), map (.at) (reduce last visits), reduce (last_or 0) (map (.at) visits)") == ["[1]", "[10]", "10"]
    assert s.run("is_empty visits, at_most 3 visits, reduce (count_at_most 4) visits") == ["false", "false", "4"]
    assert s.run("take 3 (window_of 2 (map (.at) visits))") == ["[[1, 2], [2, 3], [3, 4]]"]
    assert s.run("rolling and_reducer (map (v -> v.at < 3) (take 4 visits))") == ["[true, true, false, false]"]


def test_aggregates_of_tables_stay_aggregates(spark):
    """A filtered known reducer collects nothing."""
    s = Session(stdlib=True)
    s.table("visits", spark.createDataFrame([(1, 2)], "at long, guest long"), "at")
    known = s.value("sum |> filtering (x -> x > 1) |> mapping (v -> v.guest)").known()
    plan = s.values["visits"].reduce(known, "r")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "sum" in plan
