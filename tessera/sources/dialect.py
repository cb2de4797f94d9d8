"""A corpus in the C of old sources, a file for each customer: braces, headers and bodies made by macros, and parameters that
are declared behind the brackets. DIALECT is the file, with @ for the key; what the reading must find stands beside it."""

from __future__ import annotations

from tessera.sources.units import Function

DIALECT = """#include <stdio.h>
#define BEGIN_@ {
#define END_@ }
#define UNTIL_@(c) while (!(c)) BEGIN_@
#define HANDLER_@(name, T) static int name(T value)
#define ENTRY_@(name) HANDLER_@(name, long) BEGIN_@
#define GLUED_@(a, b) int a##b(void)
#ifdef PLAIN_@
#define LOOP_@(n) for (;n;) {
#else
#define LOOP_@(n) if (n) { {
#endif
#define COUNT_@(n) ((n) + 1)

int open_@(int a)
BEGIN_@
    UNTIL_@(a > 3) a = next_@(a); END_@
    LOOP_@(a) a = COUNT_@(a); }
    return a;
END_@

HANDLER_@(handle_@, const char *)
{
    return check_@(value);
}
ENTRY_@(entry_@) return handle_@(0);
END_@
GLUED_@(glue_, @) { return 1; }
/* declared behind */
int add_@(a, b, compare)
    int a, *b;
    int (*compare)();
{
    return compare(a, *b);
}
struct Pair_@ *make_@(first, size, rest) const char *first; unsigned long size[]; { return find_@(first); }
int plain_@(int a);
int count_@ = 0;
namespace old@ BEGIN_@
class Box_@ BEGIN_@
    int inside(int by) BEGIN_@ return COUNT_@(by); END_@
    operator unsigned int() const { return 1; }
END_@;
int outside_@(x) int x; BEGIN_@ return x; END_@
END_@
#undef BEGIN_@
int last_@() { return 1; }
"""


def _from(a: str, b: str) -> str:
    return DIALECT[DIALECT.index(a) : DIALECT.index(b)].rstrip("\n")


_INT = ("int", False, False, False)
#: In the order of the file. A signature or body that a macro makes is its use.
FUNCTIONS = (
    Function("open_@", "int", "int open_@(int a)", _from("BEGIN_@\n    UNTIL_@", "\nHANDLER_@(h"), 4, params=(("a", *_INT),), calls=(("next_@", "next_@", "local"), ("COUNT_@", "COUNT_@", "local"))),
    Function("handle_@", "const char", "HANDLER_@(handle_@, const char *)", "{\n    return check_@(value);\n}", 1, modifiers="static", params=(("value", "const char", True, False, True),), calls=(("check_@", "check_@", "local"),)),
    Function("entry_@", "long", "ENTRY_@(entry_@)", "ENTRY_@(entry_@) return handle_@(0);\nEND_@", 1, modifiers="static", params=(("value", "long", False, False, False),), calls=(("handle_@", "handle_@", "local"),)),
    Function("glue_@", "void", "GLUED_@(glue_, @)", "{ return 1; }", params=(("", "void", False, False, False),)),
    Function("add_@", "int,int,int", _from("/* declared behind */", "{\n    return compare"), "{\n    return compare(a, *b);\n}", 1, params=(("a", *_INT), ("b", "int", True, False, False), ("compare", "int", True, False, False)), calls=(("compare", "compare", "local"),)),
    Function(
        "make_@", "const char,unsigned long,int", "struct Pair_@ *make_@(first, size, rest) const char *first; unsigned long size[];", "{ return find_@(first); }", 1,
        params=(("first", "const char", True, False, True), ("size", "unsigned long", True, False, False), ("rest", *_INT)), calls=(("find_@", "find_@", "local"),),
    ),
    Function("old@::Box_@::inside", "int", "int inside(int by)", "BEGIN_@ return COUNT_@(by); END_@", 1, params=(("by", *_INT),), calls=(("COUNT_@", "COUNT_@", "local"),)),
    Function("old@::Box_@::operator unsigned int", "", "operator unsigned int() const", "{ return 1; }"),
    Function("old@::outside_@", "int", "int outside_@(x) int x;", "BEGIN_@ return x; END_@", params=(("x", *_INT),)),
    Function("last_@", "", "int last_@()", "{ return 1; }"),
)
