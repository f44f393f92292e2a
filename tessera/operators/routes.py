"""HTTP routes: which routes a path or name means, what handles and guards them, and what is known to be covered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import citation, node_line
from ..model import EXTRACTED, MAX_ROUTES, Graph

# Fixed values.
TIERS = ["path", "route_name", "path_pattern", "path_prefix", "ancestor_prefix"]
FRAMEWORK_CALLS = ["isGranted", "denyAccessUnlessGranted"]
BUCKETS = ["authorization_covered", "authentication_only", "public_declared", "undecided", "framework_check_only", "pattern_check_only", "no_indexed_check"]
GUARD_KINDS = ["authorization", "authentication", "public", "middleware", "unknown"]
HANDLER_KINDS = ["method", "closure", "unresolved"]
STATES = ["covered", "not_proven", "undecided"]
TEXT_FIELDS = ["route_template", "route_template_reason", "provider", "handler_kind", "declared_in", "authorization_state", "authorization_reason"]
LIST_FIELDS = ["http_methods", "effective_guards"]
INVALID, UNRESOLVED, OUTSIDE, INCONSISTENT, NO_TEMPLATE = "route_field_invalid", "effective_guard_unresolved", "declared_in_outside_repo", "route_producer_inconsistent", "route_template_missing"
STATE_MISSING, KIND_UNKNOWN = "authorization-state-missing", "access-check-kind-unknown"
HOST_PATH = r"^(?:[A-Za-z]:|\\)"


def typed(attrs: Column, field: str, lists: bool = False) -> tuple[Column, Column]:
    """A JSON field as a text, or as a list of texts, and whether it has another type; null and absent are of no type."""
    return typed_value(F.try_variant_get(F.try_parse_json(F.coalesce(attrs, F.lit("{}"))), f"$.{field}", "variant"), lists)


def typed_value(v: Column, lists: bool = False) -> tuple[Column, Column]:
    """typed, of a field that is read already."""
    kind = F.schema_of_variant(v)
    good = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") if lists else kind == "STRING"
    # a list of no elements is an ARRAY<VOID>, and so is one of nulls alone
    value = F.try_variant_get(v, "$", "array<string>" if lists else "string")
    if lists:
        good = good & ~F.coalesce(F.exists(value, lambda x: x.isNull()), F.lit(False))
    good = F.coalesce(good, F.lit(False))
    return F.when(good, value), v.isNotNull() & (kind != "VOID") & ~good


def routes(nodes: DataFrame) -> DataFrame:
    """Route nodes with their fields read from attrs; v2 where route_schema is an integer of two or more (not a boolean).

    marks: what had to be discarded of a v2 route; a field of another type than expected counts as absent.
    """
    attr = lambda name: F.get_json_object(F.coalesce("attrs", F.lit("{}")), f"$.{name}")
    schema = attr("route_schema")
    # a row's attrs are parsed once, and each field is taken from them once
    r = nodes.where("kind = 'http_route'").withColumn("_json", F.try_parse_json(F.coalesce("attrs", F.lit("{}"))))
    field = lambda f: F.try_variant_get("_json", f"$.{f}", "variant")
    r = r.withColumns({f"_{f}": field(f) for f in ("route_schema", *TEXT_FIELDS, *LIST_FIELDS)})
    v2 = F.coalesce(schema.rlike(r"^\d+$") & (schema.try_cast("int") >= 2) & (F.schema_of_variant("_route_schema") == "BIGINT"), F.lit(False))
    r = r.withColumn("v2", v2)
    read = {f: typed_value(F.col(f"_{f}")) for f in TEXT_FIELDS} | {f: typed_value(F.col(f"_{f}"), True) for f in LIST_FIELDS}
    plain = {f: attr(f) for f in ("route_path", "route_name")}
    wrong = reduce(lambda a, b: a | b, [bad for _, bad in read.values()])
    state, kind = read["authorization_state"][0], read["handler_kind"][0]
    wrong = wrong | (state.isNotNull() & ~state.isin(STATES)) | (kind.isNotNull() & ~kind.isin(HANDLER_KINDS))
    marks = F.when(F.col("v2") & wrong, F.array(F.lit(INVALID))).otherwise(F.array().cast("array<string>"))
    r = r.select(*nodes.columns, "v2", *[c.alias(f) for f, c in plain.items()], *[c.alias(f) for f, (c, _) in read.items()], marks.alias("marks"))
    return r.withColumn("path", F.coalesce(F.nullif("route_path", F.lit("")), F.col("label"), F.lit("")))


def segments(path: Column) -> Column:
    return F.filter(F.split(F.trim(path), "/"), lambda s: s != "")


def _is_param(s: Column) -> Column:
    return s.startswith("{") & s.endswith("}")


def _match(query: Column, route: Column) -> Column:
    """Segment by segment over the shorter of the two, equal or a placeholder of the route's."""
    n = F.least(F.size(query), F.size(route))
    return F.forall(F.zip_with(F.slice(query, F.lit(1), n), F.slice(route, F.lit(1), n), lambda q, r: (q == r) | _is_param(r)), lambda x: x)


def resolve(routes_df: DataFrame, arg: str) -> DataFrame:
    """Routes of the first tier that matches, with its name as match.

    Tiers: the path (or a v2 template); the name; placeholders as wildcards, where trailing optional ones of v2 may be
    left out; routes under the path; the longest routes above it. Each route gets its own best tier, and the least of
    all decides.
    """
    wanted = arg.strip()
    absolute = wanted.startswith("/")
    q = [s for s in wanted.split("/") if s]
    trimmed = ("/" + "/".join(q)) if absolute else wanted
    bare = F.lit(trimmed.rstrip("/"))
    template = F.when(F.col("v2"), F.nullif("route_template", F.lit("")))
    tail = lambda c: F.regexp_replace(c, "/+$", "")
    exact = ((tail(F.col("path")) == bare) | F.coalesce(tail(template) == bare, F.lit(False))) if trimmed else F.lit(False)
    r = routes_df.withColumn("_seg", F.when(~F.col("v2"), segments(F.col("path"))).otherwise(segments(template))).withColumn("_any", F.coalesce("_seg", segments(F.col("path"))))
    query = F.array(*map(F.lit, q)) if q else F.array().cast("array<string>")
    n, k = F.size("_seg"), len(q)
    optional = F.when(F.col("v2"), F.aggregate(F.reverse("_seg"), F.struct(F.lit(0).alias("c"), F.lit(True).alias("on")), lambda a, s: F.struct((a["c"] + F.when(a["on"] & _is_param(s) & s.endswith("?}"), 1).otherwise(0)).alias("c"), (a["on"] & _is_param(s) & s.endswith("?}")).alias("on")), lambda a: a["c"])).otherwise(F.lit(0))
    off = F.lit(False)
    pattern = F.coalesce((n - optional <= k) & (n >= k) & _match(query, F.col("_seg")) & (F.lit(bool(q)) | F.col("v2")), off) if absolute else off
    m = F.size("_any")
    under = (m > k) & _match(query, F.col("_any")) if absolute and q else off
    above = (m > 0) & (m < k) & _match(query, F.col("_any")) if absolute and q else off
    tier = F.when(exact, 0).when(F.col("route_name") == wanted, 1).when(pattern, 2).when(under, 3).when(above, 4)
    r = r.withColumn("_tier", tier).where("_tier is not null")
    # the least tier of all, and the longest route of the last one: one row
    least, longest = r.agg(F.min("_tier"), F.max(F.when(F.col("_tier") == 4, F.size("_any")))).first()
    r = r.where(F.col("_tier") == F.lit(least)) if least is not None else r.limit(0)
    if least == 4:
        r = r.where(F.size("_any") == F.lit(longest))
    return r.withColumn("match", F.element_at(F.array(*map(F.lit, TIERS)), F.col("_tier") + 1)).drop("_seg", "_any", "_tier")


def template_skipped(routes_df: DataFrame, arg: str, match: str | None) -> bool:
    """A route of v2 had no template, and wildcards were asked for."""
    if match in TIERS[:2] or not arg.strip().startswith("/"):
        return False
    return not routes_df.where("v2 and coalesce(route_template, '') = ''").isEmpty()


def ordered(df: DataFrame, most: int = MAX_ROUTES) -> DataFrame:
    return df.orderBy(F.coalesce("source_file", F.lit("")), F.coalesce(node_line(F.col("line"), F.lit("")), F.lit(0)), "path", "id").limit(most)


def out_edges(edges: DataFrame, relation: str) -> DataFrame:
    return edges.where((F.col("relation") == relation) & (F.coalesce("confidence", F.lit(EXTRACTED)) == EXTRACTED))


def _attr(name: str, column: str = "attrs") -> Column:
    return F.get_json_object(F.coalesce(column, F.lit("{}")), f"$.{name}")


def _text(name: str, column: str = "attrs") -> Column:
    """A field that is a text; one of any other type counts as absent."""
    return typed(F.col(column), name)[0]


def path_in_repo(path: Column, root: str | None = None) -> tuple[Column, Column]:
    """A path inside its repo, and whether it had to be withheld: a host path outside root (or with none to hold it against), or one that leaves the repo.

    Folders are gone through with a stack: '.' and empty ones say nothing, '..' takes back the last one.
    """
    raw, base = F.coalesce(path, F.lit("")), (root or "").rstrip("/")
    inside = raw.startswith(base + "/") if base else F.lit(False)
    rest = F.when(inside, F.substring(raw, F.lit(len(base) + 2), F.length(raw))).otherwise(raw)
    bad = raw.rlike(HOST_PATH) | (raw.startswith("/") & ~inside)

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when((part == "") | (part == "."), acc).when((part == "..") & up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    stack = F.aggregate(F.split(rest, "/"), F.array().cast("array<string>"), step)
    clean = F.array_join(stack, "/")
    bad = bad | ((raw != "") & ((clean == "") | (F.get(stack, F.lit(0)) == "..")))
    return F.when(bad, F.lit("")).otherwise(clean), bad


def is_host_path(path: Column) -> Column:
    """A path that says where its host keeps files."""
    raw = F.coalesce(path, F.lit(""))
    return raw.startswith("/") | raw.rlike(HOST_PATH)


EDGE_TEXTS = ["provider", "_via", "guard_kind", "check_kind"]


def evidence(g: Graph, matched: DataFrame, root: str | None = None) -> DataFrame:
    """A row for each matched route with its handlers, guards and access checks.

    Guards stand on the route, on its handler or on the handler's class, which is the first node with a method edge to
    it. Edges are v2 if their route or their handler is. A check's kind: for v2 as its edge says, 'framework' or else
    'pattern'; before v2 as it says or else by the call that is made. On v2 data files go through path_in_repo, keys of
    host paths are withheld, and kinds that are none count as absent; marks tells of it.
    """
    raw = F.coalesce("source_file", F.lit(""))
    named = g.keyed().select(F.col("id").alias("nid"), F.col("label").alias("n_label"), F.col("repo").alias("n_repo"), raw.alias("n_file"), F.col("kind").alias("n_kind"), F.col("attrs").alias("n_attrs"), F.col("key").alias("n_key"), node_line(F.col("line"), F.lit("")).alias("n_line"))
    r = matched.select("id", "repo", "v2")
    handled = r.join(out_edges(g.edges, "handled_by").select(F.col("source").alias("id"), F.col("target").alias("handler"), _text("_via").alias("via"), _text("provider").alias("h_provider")), "id")
    any_v2 = routes(g.nodes).where("v2").select(F.col("id").alias("source"))
    v2_handler = out_edges(g.edges, "handled_by").join(handled.select(F.col("handler").alias("target")).distinct(), "target", "left_semi").join(any_v2, "source", "left_semi").select(F.col("target").alias("handler"), F.lit(True).alias("h_v2")).distinct()
    owner = g.edges.where("relation = 'method'").groupBy(F.col("target").alias("handler")).agg(F.min_by("source", F.struct("ord", "source") if "ord" in g.edges.columns else F.struct("source")).alias("cls"))
    h = handled.join(owner, "handler", "left").join(v2_handler, "handler", "left").withColumn("h_v2", F.coalesce("h_v2", F.lit(False)))
    own = lambda at, scope, v2: (F.col(at).alias("at"), F.lit(scope).alias("scope"), F.col(v2).alias("e_v2"))
    places = r.select("id", *own("id", "route", "v2")).unionByName(h.select("id", *own("handler", "method", "h_v2"))).unionByName(h.where("cls is not null").select("id", *own("cls", "class", "h_v2")))
    places = places.groupBy("id", "at", "scope").agg(F.max("e_v2").alias("e_v2"))
    kind = lambda c: F.when(F.col(c).isin(GUARD_KINDS), F.col(c))
    ge = out_edges(g.edges, "guarded_by").select(F.col("source").alias("at"), F.col("target").alias("guard"), _attr("guard_scope").alias("e_scope"), _attr("guard_attribute").alias("e_attribute"), _attr("guard_kind").isNotNull().alias("e_has"), *[_text(t).alias(f"e_{t}") for t in ("guard_kind", "provider", "_via")])
    guards = places.join(ge, "at").join(named, F.col("guard") == F.col("nid"), "left").withColumns({"n_guard_kind": _text("guard_kind", "n_attrs"), "n_provider": _text("provider", "n_attrs"), "n_guard_key": _text("guard_key", "n_attrs")})
    v2_only = lambda c: F.when(F.col("e_v2"), c)
    one = F.struct(
        F.col("guard"), F.coalesce("n_label", F.lit("")).alias("label"), F.coalesce(F.nullif("e_scope", F.lit("")), "scope").alias("scope"), F.coalesce(F.nullif("e_attribute", F.lit("")), _attr("guard_attribute", "n_attrs")).alias("attribute"),
        v2_only(F.coalesce(kind("e_guard_kind"), kind("n_guard_kind"))).alias("kind"), v2_only(F.coalesce(F.nullif("e_provider", F.lit("")), F.col("n_provider"))).alias("provider"), v2_only(F.col("e__via")).alias("via"), v2_only(F.col("n_guard_key")).alias("guard_key"),
    )
    guards = guards.groupBy("id").agg(F.sort_array(F.collect_set(one)).alias("guards"), F.max(F.col("e_v2") & F.col("e_has") & kind("e_guard_kind").isNull()).alias("bad_guard"))
    ce = out_edges(g.edges, "checks_access").select(F.col("source").alias("handler"), F.col("target").alias("what"), _attr("check_call").alias("call"), _attr("conditional").alias("conditional"), _attr("guard_kind").isNotNull().alias("e_has"), *[_text(t).alias(f"e_{t}") for t in ("check_kind", "guard_kind", "provider")])
    by_call = F.when(F.col("call").isin(FRAMEWORK_CALLS), "framework").otherwise("pattern")
    ckind = F.when(F.col("h_v2"), F.when(F.col("e_check_kind") == "framework", "framework").otherwise("pattern")).otherwise(F.coalesce(F.nullif("e_check_kind", F.lit("")), by_call))
    h_only = lambda c: F.when(F.col("h_v2"), c)
    check = F.struct("handler", "what", "call", ckind.alias("kind"), h_only(kind("e_guard_kind")).alias("guard_kind"), h_only(F.col("e_provider")).alias("provider"), "conditional")
    checks = h.select("id", "handler", "h_v2").join(ce, "handler").groupBy("id").agg(F.sort_array(F.collect_set(check)).alias("checks"), F.max(F.col("h_v2") & F.col("e_has") & kind("e_guard_kind").isNull()).alias("bad_check"))
    file, outside = path_in_repo(F.col("n_file"), root)
    card_file = F.when(F.col("h_v2"), file).otherwise(F.col("n_file"))
    card = F.struct(
        "handler", F.coalesce("n_label", F.lit("")).alias("label"), F.coalesce(card_file, F.lit("")).alias("file"), "cls",
        F.when(~(F.col("h_v2") & is_host_path(F.col("n_file"))), F.col("n_key")).alias("key"), citation(F.col("repo"), card_file, F.col("n_line")).alias("citation"), F.when(F.col("v2"), F.col("via")).alias("via"), F.when(F.col("v2"), F.col("h_provider")).alias("provider"),
    )
    hs = h.join(named, F.col("handler") == F.col("nid"), "left").groupBy("id").agg(F.sort_array(F.collect_set(card)).alias("handlers"), F.max(F.col("h_v2") & outside).alias("handler_outside"))
    eff = matched.where("v2").select("id", "repo", F.explode_outer("effective_guards").alias("guard")).join(named, F.col("guard") == F.col("nid"), "left")
    good = F.coalesce((F.col("n_kind") == "access_guard") & (F.col("n_repo") == F.col("repo")), F.lit(False))
    eff = eff.withColumn("e_kind", _text("guard_kind", "n_attrs"))
    eff = eff.groupBy("id").agg(F.sort_array(F.collect_set(F.when(good, F.coalesce(kind("e_kind"), F.lit("none"))))).alias("effective_kinds"), F.max(F.col("guard").isNotNull() & ~good).alias("guard_missing"))
    out = matched
    for df in (hs, guards, checks, eff):
        out = out.join(df, "id", "left")
    stated, out_of_repo = path_in_repo(F.coalesce(F.nullif("declared_in", F.lit("")), F.col("source_file")), root)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    more = F.array_compact(F.array(F.when(F.col("v2") & (yes("bad_guard") | yes("bad_check")), INVALID), F.when(yes("guard_missing"), UNRESOLVED), F.when(F.col("v2") & (out_of_repo | yes("handler_outside")), OUTSIDE)))
    out = out.withColumn("marks", F.array_sort(F.array_union("marks", more)) if "marks" in matched.columns else F.array_sort(more))
    return out.withColumn("declared", F.when(F.col("v2"), stated)).drop("bad_guard", "bad_check", "handler_outside")


def judged(ev: DataFrame) -> DataFrame:
    """ev with distrust_reason (why a v2 route is not to be trusted, or null), bucket and reason.

    A v2 route contradicts itself if a stated kind of handler does not fit what handles it (a method has a handler, the
    others have none), if its state and its authorization guards differ, or if a framework check has no kind.
    """
    kinds = F.coalesce("effective_kinds", F.array().cast("array<string>"))
    checks, guards, handlers = F.col("checks"), F.col("guards"), F.coalesce(F.size("handlers"), F.lit(0))
    framework = F.filter(checks, lambda c: c["kind"] == "framework")
    some = lambda array, f: F.coalesce(F.exists(array, f), F.lit(False))
    fkind = lambda k: some(framework, lambda c: F.coalesce(c["guard_kind"] == k, F.lit(False)))
    state = F.when(F.col("authorization_state").isin(STATES), F.col("authorization_state")).otherwise("undecided")
    guards_auth = some(guards, lambda x: F.coalesce(x["kind"] == "authorization", F.lit(False)))
    has = lambda k: F.array_contains(kinds, k)
    stated = F.col("handler_kind").isin(HANDLER_KINDS)
    wrong = (
        F.coalesce(stated & ((F.col("handler_kind") == "method") != (handlers > 0)), F.lit(False))
        | ((state == "covered") & ~has("authorization"))
        | ((state == "not_proven") & has("authorization"))
        | ((state == "not_proven") & (F.size(kinds) == 0) & guards_auth)
        | some(framework, lambda c: c["guard_kind"].isNull())
    )
    distrust = F.when(F.col("v2"), F.when(F.coalesce("guard_missing", F.lit(False)), "guard-missing").when(wrong, "producer-inconsistent"))
    n_checks, n_framework = F.coalesce(F.size(checks), F.lit(0)), F.coalesce(F.size(framework), F.lit(0))
    v2 = (
        F.when(distrust.isNotNull(), "undecided").when(state == "covered", "authorization_covered").when(state == "undecided", "undecided").when(fkind("authorization"), "framework_check_only")
        .when(has("authentication") | fkind("authentication"), "authentication_only").when(has("public"), "public_declared").when(n_framework > 0, "undecided").when(n_checks > 0, "pattern_check_only").otherwise("no_indexed_check")
    )
    old = F.when((F.coalesce(F.size(guards), F.lit(0)) > 0) | (n_framework > 0), "guarded_or_framework_checked").when(n_checks > 0, "pattern_check_only").otherwise("no_indexed_check")
    out = ev.withColumn("distrust_reason", distrust).withColumn("bucket", F.when(F.col("v2"), v2).otherwise(old))
    if "marks" in ev.columns:
        out = out.withColumn("marks", F.when(F.coalesce(F.col("distrust_reason") == "producer-inconsistent", F.lit(False)), F.array_sort(F.array_union("marks", F.array(F.lit(INCONSISTENT))))).otherwise(F.col("marks")))
    said = F.when(state == "undecided", F.nullif("authorization_reason", F.lit("")))
    why = F.coalesce("distrust_reason", said, F.when(state == "not_proven", KIND_UNKNOWN).otherwise(STATE_MISSING))
    return out.withColumn("reason", F.when(F.col("v2") & (F.col("bucket") == "undecided"), why))


def coverage(judged_df: DataFrame) -> DataFrame:
    """(v2, bucket, n_routes): routes by exclusive bucket."""
    return judged_df.groupBy("v2", "bucket").agg(F.count("*").alias("n_routes"))


def reasons(judged_df: DataFrame) -> DataFrame:
    """(reason, n_routes): why routes are undecided."""
    return judged_df.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n_routes"))


# What is said of every answer on routes, by what the graph holds.
NOTES = {
    "source": "Routes come from attribute extraction (#[Route]); routes declared in YAML/XML config or registered at runtime are not indexed.",
    "source_v2": "Routes come from what the extractor indexed for each provider (attributes, route files, route config); routes registered at runtime are not indexed.",
    "ancestor": "No indexed route matches the full path; these are the longest indexed routes whose path is a prefix of it. The exact route may be missing from the index: confirm in source.",
    "no_guards": "This generation carries no guarded_by edges, so guards are unknown, not absent.",
    "no_checks": "This generation carries no checks_access edges, so in-body access checks are unknown, not absent.",
    "class_guard": "A guard with scope 'class' comes from the controller class and applies to every action in it.",
}


def notes(edges: DataFrame, routes_df: DataFrame, shown: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """What an answer is to be read with: notes, markers, and the providers of the v2 routes shown. Two rows and a row for each provider come to the driver."""
    has = {r["relation"] for r in edges.where(F.col("relation").isin("guarded_by", "checks_access")).select("relation").distinct().collect()}
    any_v2 = bool(routes_df.agg(F.max("v2")).first()[0])
    said, marks = ["source_v2" if any_v2 else "source", "class_guard" if "guarded_by" in has else "no_guards"], []
    if "guarded_by" not in has:
        marks.append("guards_not_indexed")
    if "checks_access" not in has:
        said.append("no_checks")
        marks.append("access_checks_not_indexed")
    providers = sorted(r["provider"] for r in shown.where("v2 and coalesce(provider, '') <> ''").select("provider").distinct().collect())
    return [NOTES[x] for x in said], marks, providers


def controller_files(ev: DataFrame) -> DataFrame:
    """(id, file): where a route is listed: before v2 its own file; for v2 its handlers' files, else where it is declared."""
    own = F.array(F.coalesce("source_file", F.lit("")))
    files = F.array_sort(F.array_distinct(F.filter(F.transform("handlers", lambda h: h["file"]), lambda x: F.coalesce(x, F.lit("")) != "")))
    listed = F.when(~F.col("v2"), own).when(F.coalesce(F.size(files), F.lit(0)) > 0, files).otherwise(F.array(F.coalesce("declared", F.lit(""))))
    return ev.select("id", F.explode(listed).alias("file")).where("file <> ''")


def outline_files(files: DataFrame, target: str) -> DataFrame:
    """(file, match): controller files that a target means: the file, a suffix of its path, a directory, or a class by its file's name; the first that matches."""
    t = target.strip().strip("/") if "/" in target else target.strip()
    short = t.lstrip("\\").rsplit("\\", 1)[-1]
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    tier = F.when(F.col("file") == t, 0).when(F.col("file").endswith("/" + t), 1).when(F.col("file").startswith(t + "/") | F.col("file").contains("/" + t + "/"), 2).when(stem == short, 3)
    f = files.select("file").distinct().withColumn("_t", tier).where("_t is not null")
    least = f.agg(F.min("_t")).first()[0]
    return f.where(F.col("_t") == F.lit(least)).select("file", F.element_at(F.array(*map(F.lit, ["file", "suffix", "directory", "class"])), F.col("_t") + 1).alias("match"))
