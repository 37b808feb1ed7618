"""Per-file data flow: variables, hits, taint, flows, call graph.

``analyze`` adds the results of a file as array columns to its row. All joins inside a file (by line,
by containment, by interval, as-of) and the taint fixpoint are array expressions on that row: the
whole analysis is one map-only stage, whatever the number of files. ``table`` gives one result as
rows. Some of these expressions loop over pairs of facts; ``flow_tables`` answers the same for long files.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expressions import empty, let, null, struct, text
from tracewell.functions.rows import explode_structs
from tracewell.operators import facts, match
from tracewell.operators.facts import KEYS
from tracewell.rules.project import attach

NO_VALIDATION = "No validation attempts detected"

TAINT = ("struct<variable:string,line_no:int,source:string,code:string,transformed_from:string,"
         "transformations:array<string>,hop:int>")
MARKED = "struct<ord:int,name:string,src:string>"
WRITE = "struct<kind:int,wo:int,line_no:int,text:string>"
BEST = "struct<pn:string,src:string,line_no:int,text:string>"
FLOW_PART = "struct<type:string,line_no:int,code:string>"
EDGE = "struct<call_ord:int,callee:string,line_no:int,caller:string,caller_line:int,caller_ix:int>"


def _mentions(value: str, name: str, word: bool) -> str:
    plain = f"contains({value}, {name})"
    if not word:
        return plain
    edge = "[^0-9A-Za-z_]"
    return (f"({plain} and rlike({value}, concat('(?:^|{edge})\\\\Q', {name}, "
            f"'\\\\E(?:$|{edge})')))")


def taints_expr(max_hops: int | None = None, word: bool = False, chain_calls: bool = False) -> str:
    """Seeds, then values reached hop by hop, then values assigned from calls on tainted names.

    Each variable is reached once: at its smallest hop, from the parent with the lowest ordinal,
    initializer before later assignment. Each hop reaches a new variable or ends the walk, so the
    number of variables bounds the hops; ``max_hops`` cuts them earlier.
    """
    most = "greatest(size(vs), 1)" if max_hops is None else str(max_hops)
    first = "array(struct(0 as kind, 0 as wo, v.line_no as line_no, v.initializer as text))"
    later = ("transform(v.later_assigns, (a, i) -> "
             "struct(1 as kind, i as wo, a.line_no as line_no, a.value as text))")
    writes = f"concat({first}, {later})"
    if chain_calls:
        by_call = ("transform(filter(ca, c -> c.name = v.name), (c, i) -> "
                   "struct(2 as kind, i as wo, c.line_no as line_no, c.code as text))")
        writes = f"concat({first}, {later}, {by_call})"

    def used(value):
        return f"filter(tf, t -> contains({value}, t))"

    seed = struct(variable="v.name", line_no="v.line_no", source="s.source_type",
                  code="s.source_code", transformed_from=null("string"),
                  transformations=empty("string"), hop="0")
    reached = struct(
        variable="n.name", line_no="n.best.line_no", source="n.best.src", code="n.best.text",
        transformed_from="n.best.pn", transformations=used("n.best.text"), hop="hop")
    # the names reached last and the writes of a variable are in order, so the first that fits is the best
    told = _mentions("w.text", "p.name", word)
    best = let({"p": f"get(filter(st.frontier, p -> exists(v.writes, w -> {told})), 0)"}, let(
        {"w": f"if(p is null, {null(WRITE)}, get(filter(v.writes, w -> {told}), 0))"},
        f"if(p is null, {null(BEST)}, "
        + struct(pn="p.name", src="p.src", line_no="w.line_no", text="w.text") + ")"))
    step = let({
        "nw": "filter(transform(filter(vs, v -> not array_contains(st.seen, v.ord)), "
              f"v -> struct(v.ord as ord, v.name as name, {best} as best)), "
              "n -> n.best is not null)",
        "fr": "transform(nw, n -> struct(n.ord as ord, n.name as name, n.best.src as src))",
    }, struct(
        frontier="fr", seen="concat(st.seen, transform(nw, n -> n.ord))",
        done="concat(st.done, fr)", rows=f"concat(st.rows, transform(nw, n -> {reached}))"))
    start = struct(
        frontier=f"concat({empty(MARKED)}, f0)",
        seen=f"concat({empty('int')}, transform(f0, m -> m.ord))",
        done=f"concat({empty(MARKED)}, f0)", rows=empty(TAINT))
    assigned = struct(name=match.assigned_name("c.code", "c.function"), line_no="c.line_no",
                      function="c.function", code="c.code")
    by_call = struct(
        variable="c.name", line_no="c.line_no", source="m.src", code="c.code",
        transformed_from="m.name",
        transformations=f"if(array_contains(tf, c.function), array(c.function), {empty('string')})",
        hop=null("int"))
    call_rows = (f"flatten(transform(filter(ca, c -> array_contains(vn, c.name)), c -> transform(filter(mk, m -> "
                 f"{_mentions('c.code', 'm.name', word)}), m -> {by_call})))")
    seeds = ("flatten(transform(so, s -> transform(filter(sv, v -> v.line_no = s.line_no), "
             f"v -> {seed})))")
    return let({
        "so": "sources",
        "ca": f"filter(transform(function_calls, c -> {assigned}), c -> c.name <> '')",
        "tf": f"coalesce(transform_names, {empty('string')})",
        "vs": "transform(variables, v -> struct(v.var_ord as ord, v.name as name, "
              f"v.line_no as line_no, {writes} as writes))",
        "vn": "transform(vs, v -> v.name)",
        "sl": "transform(so, s -> s.line_no)",
        "sv": "filter(vs, v -> array_contains(sl, v.line_no))",
        "f0": "transform(sv, v -> "
              "struct(v.ord as ord, v.name as name, element_at(filter(so, s -> "
              "s.line_no = v.line_no), -1).source_type as src))",
        "rs": f"aggregate(sequence(1, {most}), {start}, (st, hop) -> "
              f"if(size(st.frontier) = 0, st, {step}))",
        "mk": "array_sort(rs.done)",
    }, f"concat({seeds}, rs.rows, array_distinct({call_rows}))")


def flows_expr(word: bool = False) -> str:
    """One entry per sink hit and taint row whose variable occurs in the sink's line."""
    between = "{0}.line_no > t.line_no and {0}.line_no < k.line_no"
    cleaned = ("transform(filter(sn, s -> " + between.format("s") + " and ("
               + _mentions("s.sanitizer_code", "t.variable", word)
               + " or coalesce(s.sanitized_variable = t.variable, false))), s -> "
               + struct(type="s.sanitizer_type", line_no="s.line_no", code="s.sanitizer_code") + ")")
    passed = ("transform(filter(cl, c -> " + between.format("c") + " and "
              + _mentions("c.code", "t.variable", word)
              + "), c -> concat('Passed to ', c.function, ' at line ', c.line_no))")
    parent = "get(filter(ta, q -> q.variable = t.transformed_from), 0)"
    origin = (f"if(t.transformed_from is null, {empty('string')}, concat("
              "array(concat('Transformed from ', t.transformed_from, ' at line ', t.line_no)), "
              + let({"pa": parent}, "if(pa.transformed_from is null, " + empty("string") +
                    ", array(concat('Originally from ', pa.transformed_from, ' at line ', "
                    "pa.line_no)))") + "))")
    path = (f"concat(array(concat('Source at line ', t.line_no)), {origin}, {passed}, "
            "array(concat('Reaches sink at line ', k.line_no)))")
    checks = ("filter(vd, a -> " + between.format("a") + " and "
              + _mentions("a.code", "t.variable", word) + ")")
    bypass = let({"rv": checks}, f"if(size(rv) = 0, array({text(NO_VALIDATION)}), flatten("
                 f"transform(rv, a -> if(size(a.bypasses) = 0, array({text(match.NO_BYPASS)}), "
                 "a.bypasses))))")
    flow = let({"cs": cleaned}, struct(
        sink_ord="ki + 1", taint_ord="t.ix + 1", source_type="t.source", source_line="t.line_no",
        source_code="t.code", sink_type="k.sink_type", sink_line="k.line_no",
        sink_code="k.sink_code", sanitized="size(cs) > 0", sanitizers="cs",
        variable="t.variable", flow_path=path, transformations="t.transformations",
        validation_bypass=bypass, sink_after_source="k.line_no > t.line_no"))
    return let({
        "sn": "sanitizers", "cl": "function_calls", "vd": "validation_attempts", "ta": "taints",
        "ti": "transform(ta, (t, i) -> struct(i as ix, t.variable, t.line_no, t.source, t.code, "
              "t.transformed_from, t.transformations))",
    }, "flatten(transform(sinks, (k, ki) -> transform(filter(ti, t -> "
       + _mentions("k.sink_code", "t.variable", word) + f"), t -> {flow})))")


def edges_expr() -> str:
    """Every call with its enclosing definition: the nearest one starting on an earlier line."""
    holder = ("array_max(transform(filter(df, d -> d.line_no < c.line_no), "
              "d -> struct(d.line_no as line_no, -d.ix as nx, d.name as name)))")
    edge = let({"ho": holder}, struct(
        call_ord="ci + 1", callee="c.function", line_no="c.line_no", caller="ho.name",
        caller_line="ho.line_no", caller_ix="-ho.nx"))
    return let({"df": "transform(defs, (d, i) -> struct(i as ix, d.line_no, d.name))"},
               f"transform(function_calls, (c, ci) -> {edge})")


def call_graph_expr() -> str:
    """Per definition name (last definition wins): its line, its calls, and who calls it."""
    nodes = ("transform(array_distinct(transform(defs, d -> d.name)), n -> "
             + let({"ix": "array_max(transform(filter(df, d -> d.name = n), d -> d.ix))"},
                   struct(name="n", line_no="df[ix].line_no",
                          calls="transform(filter(ed, e -> e.caller_ix = ix), e -> e.callee)"))
             + ")")
    back = ("flatten(transform(nd, m -> transform(filter(m.calls, f -> f = n.name), "
            "f -> m.name)))")
    return let({
        "df": "transform(defs, (d, i) -> struct(i as ix, d.line_no, d.name))",
        "ed": "call_edges", "nd": nodes,
    }, f"transform(nd, n -> {struct(name='n.name', line_no='n.line_no', calls='n.calls', called_by=back)})")


RESULTS = ("flows", "taints", "sources", "sinks", "sanitizers", "validation_attempts",
           "suspicious_patterns", "function_calls", "variables", "defs", "call_edges", "call_graph")
# The role of the rules behind each kind of hits.
HIT_ROLES = {"sources": "source", "sinks": "sink", "sanitizers": "sanitizer"}
# What each result is computed from, besides the file's own columns; earlier stages first.
NEEDS = {
    "hits": (), "variables": (), "function_calls": (), "defs": (), "validation_attempts": (),
    "suspicious_patterns": (),
    "sources": ("hits",), "sinks": ("hits",), "sanitizers": ("hits",),
    "call_edges": ("function_calls", "defs"),
    "taints": ("sources", "variables", "function_calls"),
    "call_graph": ("call_edges", "defs"),
    "flows": ("taints", "sinks", "sanitizers", "function_calls", "validation_attempts"),
}
STAGES = (
    ("hits", "variables", "function_calls", "defs", "validation_attempts", "suspicious_patterns"),
    ("sources", "sinks", "sanitizers", "call_edges"),
    ("taints", "call_graph"),
    ("flows",),
)


def _closure(results: Iterable[str]) -> set[str]:
    wanted, open_ = set(), list(results)
    while open_:
        name = open_.pop()
        if name not in wanted:
            wanted.add(name)
            open_.extend(NEEDS[name])
    return wanted


def analyze(files: DataFrame, patterns: DataFrame | None = None,
            results: Sequence[str] = RESULTS, max_hops: int | None = None, word: bool = False,
            chain_calls: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """File rows with the asked-for analysis results as array columns.

    Of the file's other columns only those in ``keep`` stay.

    ``word`` compares names as whole words instead of substrings; ``chain_calls`` lets taint go on
    through values returned by calls. Hits are looked for in the roles that the results need, and their surrounding
    lines are taken only where the hits themselves are a result.
    """
    wanted = _closure(results)
    roles = [r for n, r in HIT_ROLES.items() if n in wanted or "hits" in results]
    shown = not {"hits", *HIT_ROLES}.isdisjoint(results)
    builders = {
        "hits": lambda: match.hits_expr(roles=roles, context=shown),
        "variables": lambda: facts.variables_expr(brief="variables" not in results),
        "function_calls": lambda: facts.calls_expr(brief="function_calls" not in results), "defs": facts.defs_expr,
        "validation_attempts": match.validations_expr,
        "suspicious_patterns": match.suspicious_expr, "sources": match.sources_expr,
        "sinks": lambda: match.sinks_expr(wrappers=None if patterns is None else "wrappers"),
        "sanitizers": match.sanitizers_expr, "call_edges": edges_expr,
        "taints": lambda: taints_expr(max_hops, word, chain_calls),
        "call_graph": call_graph_expr, "flows": lambda: flows_expr(word),
    }
    frame = attach(facts.with_lines(files), patterns)
    for stage in STAGES:
        columns = {n: F.expr(builders[n]()) for n in stage if n in wanted}
        if columns:
            frame = frame.withColumns(columns)
    return frame.select(*KEYS, "language", *keep, *results)


def table(files: DataFrame, result: str, ordinal: str | None = None,
          patterns: DataFrame | None = None, **options) -> DataFrame:
    """One analysis result as a table, computing nothing else."""
    return rows_of(analyze(files, patterns, [result], **options), result, ordinal)


def rows_of(analysis: DataFrame, column: str, ordinal: str | None = None) -> DataFrame:
    """One result of ``analyze`` as a table."""
    return explode_structs(analysis, KEYS, column, ordinal)
