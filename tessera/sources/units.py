"""A second corpus of code, a file for each customer, with what the first one lacks: namespaces, classes, overloads,
templates, operators, equal names and ids, members and scoped calls, module imports, and something for every rule.

UNIT is the file, with @ for the key. What the reading must find is stated beside it, by hand, so that it can be told in
SQL without any reading.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import FILES, tasks  # noqa: F401

UNIT = """#include <string.h>
#include <time.h>
#include "unit_@.h"
export module unit@;
import <vector>;
import "helper_@.h";
import parts.unit@;
#define LIMIT_@ 3
#define SQUARE_@(x) ((x) * (x))
char *names_@[4];
enum class Color_@ { Red };
struct Dup_@ { int a; };
struct Dup_@ { int b; };
using Alias_@ = long;
typedef unsigned int uint_@;
typedef struct { int id; } Item_@;

namespace n@ {
class Base_@ { public: virtual ~Base_@() {} };
namespace inner {
class Box_@ : public Base_@, private n@::Mixin {
public:
    Box_@(int a) : size(a), items{a, 2} { reset(); }
    Box_@& operator=(const Box_@& o) { size = o.size; return *this; }
    int area() const { return size * size; }
    int size;
    std::vector<int> items;
};
}
int inner::Box_@::shrink(int by) { return area() - by; }
int n@::inner::Box_@::turn() { Dup_@ d; return Color_@::Red == 0 ? d.a : 0; }
}

// twice
template <typename T> static inline T twice_@(T value) { return value + value; }

/* two overloads */

int pick_@(int a) { return a ? a : 1; }
int pick_@(const char *a) { return (int) strlen(a); }
int n@::inner::Box_@::grow(Box_@ *other, int by) {
    other->reset();
    n@::helper(by);
    for (int i = 0; i < by; i++) { twice_@<int>(i); }
    (*hook)(by);
    table[by](1);
    [](int x) { return x; }(2);
    return pick_@(by);
}
int same_@(int a) { return 1; }
#ifdef WIDE
int wide_@(long a) {
#else
int wide_@(int a) {
#endif
    return same_@(1);
}
int same_@(int *a) { return 2; }
void drop_@(int *old) { delete [] old; delete old; }
__attribute__((noinline)) int (*choose_@(int a))(int) { return 0; }
void quiet_@() throw() {
    std::auto_ptr<int> p(0);
    time_t now = 0; localtime(&now);
    step_@();
    step_@();
    puts("a");
    puts("b");
    if (now == NULL) { free(p); }
}
"""


@dataclass(frozen=True)
class Function:
    fqn: str
    types: str
    signature: str
    body: str
    complexity: int = 0
    template: bool = False
    modifiers: str = ""
    #: name, type, pointer, reference, const
    params: tuple = ()
    #: name, display, kind
    calls: tuple = ()
    #: Blank lines above its comment, which belong to it as well.
    above: int = 0


_GROW = UNIT[UNIT.index("{\n    other") : UNIT.index("int same_@(int a)") - 1]
_QUIET = UNIT[UNIT.index("{\n    std::auto_ptr") : -1]
_A = ("a", "int", False, False, False)

#: In the order of the file.
FUNCTIONS = (
    Function("n@::Base_@::~Base_@", "", "virtual ~Base_@()", "{}", modifiers="virtual"),
    Function("n@::inner::Box_@::Box_@", "int", "Box_@(int a) : size(a), items{a, 2}", "{ reset(); }", 1, params=(_A,), calls=(("reset", "reset", "local"),)),
    Function("n@::inner::Box_@::operator=", "const Box_@", "Box_@& operator=(const Box_@& o)", "{ size = o.size; return *this; }", params=(("o", "const Box_@", False, True, True),)),
    Function("n@::inner::Box_@::area", "", "int area() const", "{ return size * size; }"),
    Function("n@::inner::Box_@::shrink", "int", "int inner::Box_@::shrink(int by)", "{ return area() - by; }", 1, params=(("by", "int", False, False, False),), calls=(("area", "area", "local"),)),
    Function("n@::inner::Box_@::turn", "", "int n@::inner::Box_@::turn()", "{ Dup_@ d; return Color_@::Red == 0 ? d.a : 0; }", 1),
    Function("twice_@", "T", "// twice\ntemplate <typename T> static inline T twice_@(T value)", "{ return value + value; }", template=True, modifiers="static,inline", params=(("value", "T", False, False, False),), above=1),
    Function("pick_@", "int", "int pick_@(int a)", "{ return a ? a : 1; }", 1, params=(_A,)),
    Function("pick_@", "const char", "int pick_@(const char *a)", "{ return (int) strlen(a); }", 1, params=(("a", "const char", True, False, True),), calls=(("strlen", "strlen", "local"),)),
    Function(
        "n@::inner::Box_@::grow", "Box_@,int", "int n@::inner::Box_@::grow(Box_@ *other, int by)", _GROW, 8, params=(("other", "Box_@", True, False, False), ("by", "int", False, False, False)),
        calls=(("reset", "other.reset", "method"), ("helper", "n@::helper", "scoped"), ("twice_@", "twice_@", "local"), ("hook", "(*hook)", "function_pointer"), ("table", "table[by]", "functor"), ("<lambda>", "<lambda>", "lambda"), ("pick_@", "pick_@", "local")),
    ),
    Function("same_@", "int", "int same_@(int a)", "{ return 1; }", params=(_A,)),
    Function("wide_@", "long", "int wide_@(long a)", "{\n#else\nint wide_@(int a) {\n#endif\n    return same_@(1);\n}", 1, params=(("a", "long", False, False, False),), calls=(("same_@", "same_@", "local"),)),
    Function("same_@", "int", "int same_@(int *a)", "{ return 2; }", params=(("a", "int", True, False, False),)),
    Function("drop_@", "int", "void drop_@(int *old)", "{ delete [] old; delete old; }", params=(("old", "int", True, False, False),)),
    Function("choose_@", "int", "__attribute__((noinline)) int (*choose_@(int a))(int)", "{ return 0; }", params=(_A,)),
    Function("quiet_@", "", "void quiet_@() throw()", _QUIET, 5, calls=(("localtime", "localtime", "local"), ("step_@", "step_@", "local"), ("puts", "puts", "local"), ("free", "free", "local"))),
)

_BOX = UNIT[UNIT.index("class Box_@") : UNIT.index(";\n}\nint inner")]
#: fqn, kind, source, bases
TYPES = (
    ("Color_@", "enum", "enum class Color_@ { Red }", ""),
    ("Dup_@", "struct", "struct Dup_@ { int a; }", ""),
    ("Dup_@", "struct", "struct Dup_@ { int b; }", ""),
    ("Alias_@", "type_alias", "using Alias_@ = long;", ""),
    ("uint_@", "typedef", "typedef unsigned int uint_@;", ""),
    ("Item_@", "typedef", "typedef struct { int id; } Item_@;", ""),
    ("n@::Base_@", "class", "class Base_@ { public: virtual ~Base_@() {} }", ""),
    ("n@::inner::Box_@", "class", _BOX, "Base_@,n@::Mixin"),
)
#: kind, target, line, raw
IMPORTS = (("module_decl", "unit@", 4, "export module unit@;"), ("import", "<vector>", 5, "import <vector>;"), ("import", '"helper_@.h"', 6, 'import "helper_@.h";'), ("import", "parts.unit@", 7, "import parts.unit@;"))
#: pattern, a text on its line, match: by line and pattern.
FINDINGS = (("char_pointer_array", "char *names_@[4];", "char *names_@[4]"), ("c_style_cast", "(int) strlen", "(int) strlen(a)"), ("manual_delete", "delete [] old", "delete [] old;"), ("manual_delete", "delete [] old", "delete old;"), ("null_macro", "now == NULL", "NULL"))
#: What each rule's description is counted as.
APPLIED = {
    "NULL -> nullptr": 1, "typedef -> using": 1, "throw() -> noexcept": 1, "#define constant -> constexpr": 1, "<string.h> -> <cstring>": 1, "<time.h> -> <ctime>": 1, "C-style cast - consider static_cast": 1, "char* pointer - consider std::string or std::string_view": 2,
    "std::auto_ptr -> std::unique_ptr (deprecated)": 1, "free usage - replace with smart pointer ownership": 1, "legacy time API - migrate to std::chrono": 2, "functional macro - migrate to constexpr inline function": 1, "redundant duplicate statement - removed consecutive call": 1,
}
#: What the rules make of the file. Of two equal statements the first is left, without its indent.
REWRITES = (
    ("#include <string.h>", "#include <cstring>"), ("#include <time.h>", "#include <ctime>"), ("#define LIMIT_@ 3", "constexpr auto LIMIT_@ = 3;"), ("typedef unsigned int uint_@;", "using uint_@ = unsigned int;"), ("throw()", "noexcept"),
    ("    step_@();\n    step_@();", "step_@();"), ("now == NULL", "now == nullptr"),
)


def rewritten() -> str:
    out = UNIT
    for a, b in REWRITES:
        out = out.replace(a, b)
    return out


def unit_corpus(spark: SparkSession, sf_dir: str, unit: str = UNIT) -> DataFrame:
    """file_id, path, text: a file for each customer."""
    k = F.col("c_custkey").cast("string")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    c = c.repartition(tasks(spark, c.count()), "c_custkey")
    return c.select(F.col("c_custkey").cast("long").alias("file_id"), F.concat(F.lit("unit/"), k, F.lit(".cpp")).alias("path"), F.replace(F.lit(unit), F.lit("@"), k).alias("text"))


def quoted(x) -> str:
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x).upper() if isinstance(x, bool) else str(x)


def unit_sql(names: str, rows) -> str:
    """A DuckDB subquery: each row for each customer, with the key (file_id, k) and its @ replaced."""
    cols = [x.strip() for x in names.split(",")]
    rows = list(rows)
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    out = ", ".join(f"replace(v.{c}, '@', CAST(c_custkey AS VARCHAR)) AS {c}" if isinstance(rows[0][i], str) else f"v.{c}" for i, c in enumerate(cols))
    return f"(SELECT c_custkey AS file_id, CAST(c_custkey AS VARCHAR) AS k, {out} FROM customer, (VALUES {values}) v({', '.join(cols)}))"
