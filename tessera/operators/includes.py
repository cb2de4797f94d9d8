"""Which headers a function needs, by the symbols in its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The symbols that ask for a header.
SYMBOLS = {
    "<vector>": ("std::vector", "vector"),
    "<string>": ("std::string", "string", "string_view"),
    "<map>": ("std::map", "map", "multimap"),
    "<unordered_map>": ("std::unordered_map", "unordered_map", "unordered_multimap"),
    "<set>": ("std::set", "set", "multiset"),
    "<unordered_set>": ("std::unordered_set", "unordered_set", "unordered_multiset"),
    "<memory>": ("std::unique_ptr", "std::shared_ptr", "unique_ptr", "shared_ptr", "weak_ptr"),
    "<optional>": ("std::optional", "optional"),
    "<variant>": ("std::variant", "variant"),
    "<tuple>": ("std::tuple", "tuple"),
    "<utility>": ("std::move", "std::forward", "move", "forward"),
    "<algorithm>": ("std::sort", "std::find", "sort", "find"),
    "<iostream>": ("std::cout", "std::cin", "std::cerr", "cout", "cin", "cerr"),
    "<sstream>": ("std::stringstream", "std::ostringstream", "std::istringstream"),
    "<thread>": ("std::thread", "thread"),
    "<mutex>": ("std::mutex", "std::lock_guard", "mutex", "lock_guard"),
    "<chrono>": ("std::chrono", "chrono"),
    "<span>": ("std::span", "span"),
    "<expected>": ("std::expected", "expected", "unexpected"),
    "<format>": ("std::format", "format", "vformat"),
    "<print>": ("std::print", "print", "println"),
    "<ranges>": ("std::ranges", "ranges", "views"),
}


def include_requirements(functions: DataFrame, headers: DataFrame) -> DataFrame:
    """file_id, id, header: standard headers by their symbols, and project headers of the file by their stems.

    A standard header is one literal alternation, so the text is read once a header and no table is joined. A project
    header needs its stem among the words of the text: an equi-join on (file, word).
    """
    display = F.array_join(F.transform("call_details", lambda c: c.display), "\n")
    f = functions.select("file_id", F.col("unique_fqn").alias("id"), F.concat_ws("\n", "signature", "body", display).alias("t"))
    alt = lambda s: r"(?<!\w)(?:" + "|".join(r"\Q" + x + r"\E" for x in s) + r")(?!\w)"
    std = f.select("file_id", "id", F.explode(F.filter(F.array(*[F.when(F.col("t").rlike(alt(s)), h) for h, s in SYMBOLS.items()]), lambda x: x.isNotNull())).alias("header"))
    own = headers.select("file_id", F.regexp_extract("header", r'include\s*("[^"]+")', 1).alias("header")).where("header <> ''")
    own = own.select("file_id", "header", F.regexp_extract("header", r'([^/"]+?)(?:\.[^."/]*)?"$', 1).alias("stem"))
    words = f.select("file_id", "id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\w+"), F.lit(0)))).alias("stem"))
    return std.union(words.join(own, ["file_id", "stem"]).select("file_id", "id", "header")).distinct()
