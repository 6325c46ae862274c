"""UI markup (XML with namespaces) as a table of nodes, and what is read off it: classes, references, resources.

Parsing runs in Arrow-fed Python, one document at a time; everything after it is built-in functions on NODES.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values, as the documents' vocabulary defines them.
PRESENTATION = "http://schemas.microsoft.com/winfx/2006/xaml/presentation"
XAML = "http://schemas.microsoft.com/winfx/2006/xaml"
DESIGN = "http://schemas.microsoft.com/expression/"
ROOT_TAGS = ("Application", "NavigationWindow", "Page", "ResourceDictionary", "UserControl", "Window")
CONTAINER_TAGS = ("Canvas", "DockPanel", "Grid", "Panel", "StackPanel", "UniformGrid", "Viewbox", "VirtualizingPanel", "VirtualizingStackPanel", "WrapPanel")
RESOURCE_TAGS = ("ControlTemplate", "DataTemplate", "DataTrigger", "HierarchicalDataTemplate", "MultiDataTrigger", "MultiTrigger", "ResourceDictionary", "Setter", "Style", "Trigger")
RESOURCE_SCOPES = ("ResourceDictionary", "Setter", "Style", "Trigger", "DataTrigger", "MultiTrigger", "MultiDataTrigger")
TEMPLATE_SCOPES = ("ControlTemplate", "DataTemplate", "ItemsPanelTemplate")
NONVISUAL_TAGS = ("Binding", "ColumnDefinition", "Condition", "DynamicResource", "EventSetter", "InputBinding", "KeyBinding", "MultiBinding", "PriorityBinding", "RelativeSource", "RowDefinition", "Run", "StaticResource")
BASE_CONTROLS = (
    "Border BulletDecorator Button Calendar Canvas CheckBox ComboBox ContextMenu DataGrid DatePicker DockPanel DocumentViewer Expander "
    "FlowDocumentPageViewer FlowDocumentReader FlowDocumentScrollViewer Frame Grid GridSplitter GroupBox Image Label ListBox ListView Menu Panel "
    "PasswordBox Popup ProgressBar PrintDialog RadioButton RepeatButton RichTextBox ScrollBar ScrollViewer Separator Slider StackPanel StatusBar "
    "TabControl TextBlock TextBox ToolBar ToolTip TreeView WrapPanel Viewbox"
).split()
EVENT_ATTRIBUTES = (
    "Activated Checked Click Closed Closing DataContextChanged DoubleClick DragEnter DragLeave DragOver Drop GotFocus Initialized KeyDown KeyUp Loaded "
    "LostFocus MouseDoubleClick MouseDown MouseEnter MouseLeave MouseMove MouseUp Navigated Navigating Opened Selected SelectionChanged TextChanged "
    "Unchecked Unloaded ValueChanged"
).split()
PATH_ATTRIBUTES = ("Cursor", "FontFamily", "Icon", "ImageSource", "NavigateUri", "Source", "UriSource")
FILE_SUFFIXES = "avi bmp csv cur gif ico jpeg jpg json m4a mp3 mp4 otf pdf png resx svg tif tiff ttf txt wav webm webp wmv woff woff2 xml xaml yaml yml".split()
INVISIBLE_SUFFIXES = ("action", "behavior", "collection", "command", "converter", "extension", "preset", "provider", "service", "transition", "trigger", "validator", "viewmodel")
DATA_PROVIDERS = ("XmlDataProvider", "ObjectDataProvider", "CollectionViewSource")
KEY_ATTRIBUTES = ("Key", "x:Key", "x:Name", "Name")
MARKUP_KINDS = {"MultiBinding": "multibinding", "PriorityBinding": "prioritybinding", "Binding": "binding", "StaticResource": "static_resource", "DynamicResource": "dynamic_resource"}

DETAIL = "struct<name:string,full_name:string,namespace:string,value:string>"
NODES = (
    f"source_id string, ordinal long, parent long, depth int, tag string, namespace string, full_tag string, node_path string, above array<string>, "
    f"text string, tail string, line long, attributes map<string,string>, details array<{DETAIL}>, n_children long, error string"
)


#: Nodes in a batch that a parser gives back, at least where it has as many; a document's are never split.
BATCH_NODES = 8192


def _types(columns: Sequence[str]) -> str:
    """NODES without other columns."""
    kinds = dict(c.split(" ", 1) for c in re.split(r", (?=\w+ )", NODES))
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


#: Names of tags and attributes that a reader remembers in parts.
KNOWN_NAMES = 4096


def _split(known: dict, full: str) -> tuple[str | None, str, str]:
    """(namespace, local, {namespace}local) of a name as the parser gives it, from known ones if it is among them."""
    if full not in known:
        if len(known) >= KNOWN_NAMES:
            known.clear()
        namespace, _, local = full.rpartition(" ")
        known[full] = (namespace or None, local, f"{{{namespace}}}{local}" if namespace else local)
    return known[full]


#: How many flat lists a column of lists has.
FLAT = {"above": 1, "attributes": 2, "details": 4}


class _Reader:
    """Documents' start tags in document order, a list a wanted column; text is what stands before the first child, tail what
    follows the end tag. Unwanted columns cost nothing. Columns of lists have where each list begins, and flat lists."""

    def __init__(self, names: Sequence[str]) -> None:
        self.held: dict[str, list] = {c: [] for c in names}
        self.flat = {c: tuple([] for _ in range(FLAT[c])) for c in names if c in FLAT}
        self.rows = 0
        self.known: dict = {}
        # Open elements: ordinal, path, numbers of children by tag, and the tags above a child, once it has one.
        self.open: list[list] = []
        self.n, self.children, self.texts, self.tails = 0, [], [], []
        self.ended: int | None = None
        self.parser = None
        self.start = self._starter()

    def _starter(self):
        held, known, open_ = self.held, self.known, self.open
        add = lambda c: held[c].append if c in held else None
        ordinal, parent_, depth, tag_, namespace_, full_tag, node_path, line = map(add, ("ordinal", "parent", "depth", "tag", "namespace", "full_tag", "node_path", "line"))
        above, attributes_, details = (held.get(c) for c in ("above", "attributes", "details"))
        (tags,) = self.flat.get("above", (None,))
        keys, values = self.flat.get("attributes", (None, None))
        names, fulls, spaces, contents = self.flat.get("details", (None,) * 4)
        texts = "text" in held or "tail" in held
        counted = texts or "n_children" in held

        def start(name: str, attributes: list) -> None:
            namespace, tag, full = known.get(name) or _split(known, name)
            n = self.n
            top = open_[-1] if open_ else None
            path = None
            if node_path:
                if top:
                    counts = top[2]
                    k = counts[tag] = counts.get(tag, 0) + 1
                    path = f"{top[1]}/{tag}[{k}]"
                else:
                    path = f"/{tag}[1]"
                node_path(path)
            if ordinal:
                ordinal(n)
            if parent_:
                parent_(top[0] if top else None)
            if depth:
                depth(len(open_))
            if tag_:
                tag_(tag)
            if namespace_:
                namespace_(namespace)
            if full_tag:
                full_tag(full)
            if line:
                line(self.parser.CurrentLineNumber)
            over = None
            if above is not None:
                above.append(len(tags))
                if top:
                    tags.extend(top[3])
                    over = [tag, *top[3]]
                else:
                    over = [tag]
            if attributes_ is not None:
                attributes_.append(len(keys))
                if attributes:
                    own = {(known.get(x) or _split(known, x))[1]: attributes[i + 1] for i, x in enumerate(attributes) if not i % 2}
                    keys.extend(own)
                    values.extend(own.values())
            if details is not None:
                details.append(len(names))
                for i in range(0, len(attributes), 2):
                    x = attributes[i]
                    space, local, whole = known.get(x) or _split(known, x)
                    names.append(local)
                    fulls.append(whole)
                    spaces.append(space)
                    contents.append(attributes[i + 1])
            open_.append([n, path, {}, over])
            if counted:
                if top:
                    self.children[top[0]] += 1
                self.children.append(0)
            if texts:
                self.texts.append("")
                self.tails.append("")
                self.ended = None
            self.n = n + 1

        return start

    def _end(self, _name: str) -> None:
        self.ended = self.open.pop()[0]

    def _data(self, text: str) -> None:
        if self.ended is not None and self.open:
            self.tails[self.ended] += text
        elif self.open and not self.children[self.open[-1][0]]:
            self.texts[self.open[-1][0]] += text

    def read(self, source: str, xml: str | None) -> None:
        """A document's own rows, in every column; if it is not well-formed one, with its error."""
        held = self.held
        before, flat = {c: len(x) for c, x in held.items()}, {c: len(x[0]) for c, x in self.flat.items()}
        self.open.clear()
        self.n, self.children, self.texts, self.tails, self.ended = 0, [], [], [], None
        parser = self.parser = expat.ParserCreate(namespace_separator=" ")
        parser.ordered_attributes = True
        parser.StartElementHandler, parser.EndElementHandler = self.start, self._end
        if "text" in held or "tail" in held:
            parser.buffer_text = True
            parser.CharacterDataHandler = self._data
        try:
            parser.Parse(xml or "", True)
        except (expat.ExpatError, ValueError) as e:
            for c, n in flat.items():
                for x in self.flat[c]:
                    del x[n:]
            for c, x in held.items():
                del x[before[c] :]
                x.append(source if c == "source_id" else str(e) if c == "error" else None)
            self.rows += 1
            return
        own = {"source_id": lambda: [source] * self.n, "error": lambda: [None] * self.n, "n_children": lambda: self.children}
        own |= {"text": lambda: [x.strip() or None for x in self.texts], "tail": lambda: [x.strip() or None for x in self.tails]}
        for c in own.keys() & held.keys():
            held[c] += own[c]()
        self.rows += self.n

    def batch(self) -> pa.RecordBatch:
        """All rows so far, which are forgotten."""
        out = pa.RecordBatch.from_arrays([self._arrow(c) for c in self.held], list(self.held))
        for x in (*self.held.values(), *(x for lists in self.flat.values() for x in lists)):
            x.clear()
        self.rows = 0
        return out

    def _arrow(self, column: str) -> pa.Array:
        rows = self.held[column]
        if column not in FLAT:
            return pa.array(rows, {"ordinal": pa.int64(), "parent": pa.int64(), "depth": pa.int32(), "line": pa.int64(), "n_children": pa.int64()}.get(column, pa.string()))
        flat = [pa.array(x, pa.string()) for x in self.flat[column]]
        starts = pa.array([*rows, len(flat[0])], pa.int32())
        if column == "attributes":
            return pa.MapArray.from_arrays(starts, *flat)
        return pa.ListArray.from_arrays(starts, flat[0] if column == "above" else pa.StructArray.from_arrays(flat, ("name", "full_name", "namespace", "value")))


def xml_nodes(documents: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """documents (source_id, xml) -> NODES, or those columns of it, a row a start tag in document order.

    node_path numbers a tag among its siblings of that tag; above: the tags above, nearest first. Declarations of
    namespaces are no attributes; of attributes with one local name the last counts in the map, details hold all. Blank text
    is null, comments are skipped. A document that is not well-formed, null or empty has one row with `error` alone. A
    document's nodes come one after another in one task."""
    schema = NODES if columns is None else _types(columns)
    names = re.findall(r"(?:^|, )(\w+) ", schema)

    def run(batches):
        reader = _Reader(names)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for source, xml in zip(part.column("source_id").to_pylist(), part.column("xml").to_pylist(), strict=True):
                    reader.read(source, xml)
                    if reader.rows >= BATCH_NODES:
                        yield reader.batch()
        if reader.rows:
            yield reader.batch()

    return documents.select("source_id", "xml").mapInArrow(run, schema)


def namespaces(documents: DataFrame) -> DataFrame:
    """documents (source_id, xml) -> (source_id, prefix, uri): declarations, the default one as 'default'; of those
    that a prefix has in one document the last counts."""
    found = F.regexp_extract_all("xml", F.lit(r"""xmlns(?::([\w.-]+))?\s*=\s*["']([^"']*)["']"""), F.lit(0))
    each = documents.select("source_id", F.posexplode(found).alias("i", "x"))
    prefix = F.regexp_extract("x", r"^xmlns:([\w.-]+)", 1)
    rows = each.select("source_id", "i", F.when(prefix == "", "default").otherwise(prefix).alias("prefix"), F.regexp_extract("x", r"""["']([^"']*)["']$""", 1).alias("uri"))
    return rows.groupBy("source_id", "prefix").agg(F.max_by("uri", "i").alias("uri"))


def expanded_name(name: Column) -> Column:
    """struct(namespace, local) of a name written {uri}local."""
    uri = F.regexp_extract(name, r"^\{([^}]*)\}", 1)
    return F.struct(F.when(uri != "", uri).alias("namespace"), F.regexp_replace(name, r"^.*\}", "").alias("local"))


def is_resources(tag: Column) -> Column:
    return tag.endswith(".Resources") | (tag == "Resources")


def is_template(tag: Column) -> Column:
    return tag.endswith("Template")


def classify(nodes: DataFrame) -> DataFrame:
    """nodes with `classification` and `reason`: one of nine classes by ordered rules. The nearest ancestor that opens
    a template or a resource scope decides whether a node is part of a resource."""
    tag, space = F.col("tag"), F.coalesce("namespace", F.lit(""))
    scope = lambda x: x.endswith(".Resources") | x.isin(*RESOURCE_SCOPES)
    nearest = F.try_element_at(F.filter("above", lambda x: x.isin(*TEMPLATE_SCOPES) | scope(x)), F.lit(1))
    low_space, low_tag = F.lower(space), F.lower(tag)
    system = low_space.rlike("clr-namespace:system|converter|validator|behaviors|interactivity") | low_tag.rlike("(action|behavior|converter|extension|trigger)$")
    foreign = (space != "") & ~space.isin(PRESENTATION, XAML)
    rules = [
        ((F.col("depth") == 0) & tag.isin(*ROOT_TAGS), "page_or_document_root", "root of the document"),
        (tag.contains("."), "property_element", "property element"),
        (tag.isin(*RESOURCE_TAGS), "resource_node", "resource, style, template or trigger"),
        (scope(nearest), "resource_node", "within a resource scope"),
        (tag.isin(*CONTAINER_TAGS), "container", "layout container"),
        (tag.isin(*BASE_CONTROLS), "base_control", "base control"),
        (tag.isin(*NONVISUAL_TAGS), "nonvisual_node", "binding or layout definition"),
        (foreign & space.startswith(DESIGN), "nonvisual_node", "design-time namespace"),
        (foreign & system, "nonvisual_node", "system value, converter, validator or behaviour"),
        (foreign, "custom_control", "namespace of its own"),
        (space == XAML, "nonvisual_node", "language namespace"),
    ]
    kind, why = F, F
    for test, name, reason in rules:
        kind, why = kind.when(F.coalesce(test, F.lit(False)), name), why.when(F.coalesce(test, F.lit(False)), reason)
    return nodes.withColumn("classification", kind.otherwise("unsupported_node")).withColumn("reason", why.otherwise("unknown element"))


def looks_like_file(value: Column) -> Column:
    """Whether a value names a file: by its scheme, an assembly's component or a known suffix."""
    plain = F.lower(F.replace(F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", ""), F.lit("\\"), F.lit("/")))
    bare = F.regexp_extract(plain, "^([^?#]*)", 1)
    return plain.rlike("^(https?|pack):") | plain.contains(";component/") | F.regexp_extract(bare, r"\.([^.]*)$", 1).isin(*FILE_SUFFIXES)


def _last(*names: str) -> list[Column]:
    """Values of the attributes of those local names, the last of each, null where there is none."""
    return [F.try_element_at(F.filter("details", lambda d: d["name"] == name), F.lit(-1))["value"] for name in names]  # noqa: B023


def references(nodes: DataFrame, keys: bool = False) -> DataFrame:
    """nodes -> (source_id, node_path, line, kind, attribute, target, raw_value, resolution): every reference that an
    attribute or a binding element makes; an attribute may make several. With keys also a row of kind `key` for each node
    with a resource's key, which is its target.

    Nodes are read once. Attributes that cannot hold a reference go first, and what begins with a brace and one of
    MARKUP_KINDS in a value, however nested, is a row before its parts are taken."""
    blank = lambda x: F.when(x != "", x)
    kinds = F.create_map(*(F.lit(x) for pair in MARKUP_KINDS.items() for x in pair))
    low_kinds = F.create_map(*(F.lit(x) for name, kind in MARKUP_KINDS.items() for x in (name.lower(), kind)))
    named = F.coalesce(*map(blank, _last("Path", "ResourceKey")))
    event = lambda name: name.isin(*EVENT_ATTRIBUTES) | name.startswith("Preview")
    some = F.filter("details", lambda d: d["value"].contains("{") | event(d["name"]) | d["name"].isin("Command", "CommandParameter", *PATH_ATTRIBUTES))
    none = lambda kind: F.lit(None).cast(kind)
    attributes = F.transform(some, lambda d: F.struct(d["name"].alias("attribute"), F.coalesce(d["value"], F.lit("")).alias("value"), none("string").alias("kind"), none("string").alias("target")))
    own = lambda test, kind, target: F.when(test, F.array(F.struct(none("string").alias("attribute"), none("string").alias("value"), kind.alias("kind"), target.alias("target")))).otherwise(F.array().cast("array<struct<attribute:string,value:string,kind:string,target:string>>"))
    of_nodes = [own(F.col("tag").isin(*MARKUP_KINDS), kinds[F.col("tag")], named)]
    if keys:
        nodes = nodes.withColumn("key", F.when(F.exists("details", lambda d: d["name"].isin(*KEY_ATTRIBUTES)), F.coalesce(*_last(*KEY_ATTRIBUTES))))
        of_nodes.append(own(F.col("key") != "", F.lit("key"), F.col("key")))
    each = nodes.select("source_id", "node_path", "line", F.inline(F.concat(attributes, *of_nodes)))

    # Candidates: (found, kind, target, resolution), of markup what was found alone.
    attr, value = F.col("attribute"), F.col("value")
    candidate = "array<struct<found:string,kind:string,target:string,resolution:string>>"
    row = lambda kind, target, how: F.struct(none("string").alias("found"), kind.alias("kind"), target.alias("target"), how.alias("resolution"))
    one = lambda test, r: F.when(test, F.array(r)).otherwise(F.array().cast(candidate))
    # One search for all names, and none of a value without a brace.
    found = F.regexp_extract_all(value, F.lit(rf"(?is)(?=(\{{(?:{'|'.join(MARKUP_KINDS)})\b.*))"), F.lit(1))
    nested = F.when(value.contains("{"), F.transform(found, lambda f: F.struct(f.alias("found"), none("string").alias("kind"), none("string").alias("target"), none("string").alias("resolution")))).otherwise(F.array().cast(candidate))
    parsed = F.lit("parsed")
    rows = [
        nested,
        one(F.col("kind").isNotNull(), row(F.col("kind"), F.col("target"), none("string"))),
        one(attr == "Command", row(F.lit("command"), value, F.when(value.contains("{"), "candidate").otherwise("parsed"))),
        one(attr == "CommandParameter", row(F.lit("command_parameter"), value, parsed)),
        one(event(attr) & F.trim(value).rlike(r"^[A-Za-z_]\w*$"), row(F.lit("event_handler"), F.trim(value), parsed)),
        one(attr.isin(*PATH_ATTRIBUTES) & looks_like_file(value), row(F.lit("file_resource"), value, F.lit("candidate"))),
    ]
    every = each.select("source_id", "node_path", "line", "attribute", F.col("value").alias("raw_value"), F.explode(F.concat(*rows)).alias("r"))

    f = F.col("r.found")
    kind = F.coalesce("r.kind", low_kinds[F.lower(F.regexp_extract(f, r"^\{(\w+)", 1))])
    taken = every.withColumn("kind", kind)
    resource = blank(F.regexp_extract(f, r"(?i)^\{(?:StaticResource|DynamicResource)\s+([^,}\s]+)", 1))
    path = F.trim(blank(F.regexp_extract(f, r"(?i)\bPath\s*=\s*([^,}]+)", 1)))
    first = blank(F.regexp_extract(f, r"(?i)^\{(?:Binding|MultiBinding|PriorityBinding)(?:\s+([^,}\s]+))?", 1))
    target = F.when(f.isNull(), F.col("r.target")).when(F.col("kind").endswith("_resource"), resource).otherwise(F.coalesce(path, first))
    taken = taken.withColumn("target", target)
    how = F.coalesce("r.resolution", F.when(F.coalesce("target", F.lit("")) != "", "parsed").otherwise("partial"))
    return taken.select("source_id", "node_path", "line", "kind", "attribute", "target", "raw_value", how.alias("resolution"))


def fold_path(parts: Column) -> Column:
    """struct(parts, escaped): a path's parts without '.' and empty ones, each '..' taking the part before it;
    escaped if there was none to take."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("escaped"))

    def step(acc: Column, x: Column) -> Column:
        up, none = x == "..", F.size(acc["parts"]) == 0
        kept = F.when(up & ~none, F.slice(acc["parts"], F.lit(1), F.size(acc["parts"]) - 1)).when(up | x.isin("", "."), acc["parts"]).otherwise(F.concat(acc["parts"], F.array(x)))
        return F.struct(kept.alias("parts"), (acc["escaped"] | (up & none)).alias("escaped"))

    return F.aggregate(parts, start, step)


def resolve(refs: DataFrame, keys: DataFrame | None, files: DataFrame) -> DataFrame:
    """References of resources and files, each in one of eight classes, with whether the target exists.

    refs as of `references`; keys (key): resource keys that exist anywhere in the project, or None if refs hold them as rows of
    kind `key`, which meet the references in one shuffle instead of a join; files (file_id, declared): the project's files. A
    file's path counts from its document's folder, or from the root with a leading slash."""
    some = refs.where(F.col("kind").isin("static_resource", "dynamic_resource", "file_resource", *["key"] * (keys is None))).withColumn("target", F.when(F.col("kind") == "key", F.col("target")).otherwise(F.trim(F.coalesce("target", F.lit("")))))
    is_file, keyed, there = F.col("kind") == "file_resource", F.coalesce("keyed", F.lit(False)), F.coalesce("there", F.lit(False))
    bare = F.regexp_extract(F.replace(F.regexp_replace("target", "^[\"']+|[\"']+$", ""), F.lit("\\"), F.lit("/")), "^([^?#]*)", 1)
    folder = F.regexp_extract("source_id", "^(.*)/[^/]*$", 1)
    folded = fold_path(F.split(F.when(F.col("bare").startswith("/"), F.col("bare")).otherwise(F.concat(folder, F.lit("/"), F.col("bare"))), "/"))
    held = some.withColumn("bare", F.when(is_file, bare)).withColumn("folded", F.when(is_file, folded)).withColumn("file_id", F.array_join("folded.parts", "/"))
    outside = F.lower("bare").rlike("^(https?|pack):") | F.lower("bare").contains(";component/")
    placed = (
        F.when(~is_file, None)
        .when(outside, "external_or_assembly")
        .when((F.col("bare") == "") | F.col("bare").startswith("{"), "unsupported")
        .when(F.col("folded.escaped") | (F.size("folded.parts") == 0), "external_or_assembly")
        .when(~there, "missing_target")
        .when(F.col("declared"), "resolved_declared_file")
        .otherwise("internal_undeclared_file")
    )
    held = held.join(files.select("file_id", "declared").withColumn("there", F.lit(True)), "file_id", "left").withColumn("placed", placed)
    # Files meet no keys: they are dealt by their documents, as many of them name the same file. There may be many keys, so
    # they are never broadcast.
    rows = held.select("source_id", "node_path", "line", "attribute", "kind", "target", "raw_value", "file_id", "placed", is_file.alias("is_file"), F.when(is_file, F.col("source_id")).otherwise(F.col("target")).alias("met"))
    if keys is None:
        is_key = F.col("kind") == "key"
        # Of a key nothing else is shuffled.
        rows = rows.select("met", "is_file", "kind", *(F.when(~is_key, F.col(c)).alias(c) for c in rows.columns if c not in ("met", "is_file", "kind")))
        rows = rows.withColumn("keyed", F.max(is_key).over(W.partitionBy("met", "is_file"))).where(~is_key)
    else:
        known = keys.select(F.col("key").alias("met")).distinct().select("met", F.lit(False).alias("is_file"), F.lit(True).alias("keyed")).hint("merge")
        rows = rows.join(known, ["met", "is_file"], "left")
    label = F.when(F.col("kind") == "dynamic_resource", "dynamic").when(F.col("is_file"), F.col("placed")).when(keyed, "resolved_internal_key").otherwise("unsupported_symbolic_reference")
    exists = F.when(F.col("is_file"), F.col("placed").isin("resolved_declared_file", "internal_undeclared_file")).otherwise(keyed)
    inside = F.col("placed").isin("missing_target", "resolved_declared_file", "internal_undeclared_file")
    return rows.select("source_id", "node_path", "line", "attribute", "kind", F.when(F.col("target") != "", F.col("target")).alias("target"), "raw_value", label.alias("classification"), exists.alias("target_exists"), F.when(inside, F.col("file_id")).alias("target_source_id"))


def key_of(attributes: Column) -> Column:
    """The first of a resource's key attributes that is there; an empty one counts."""
    return F.coalesce(*(attributes[k] for k in KEY_ATTRIBUTES))


def resources(nodes: DataFrame, custom_classes: Sequence[str] = ()) -> DataFrame:
    """Direct children of resource scopes, numbered from 1 within their document in document order; keyed ones with their
    key, others with how many children they have."""
    tag = F.col("tag")
    scope = lambda x: is_resources(x) | (x == "ResourceDictionary")
    rows = nodes.where(scope(F.try_element_at("above", F.lit(1))) & ~scope(tag) & ~tag.startswith("ResourceDictionary."))
    key = F.when(key_of(F.col("attributes")) != "", key_of(F.col("attributes")))
    data = F.when(tag.isin(*DATA_PROVIDERS), "data_provider").when(tag.isin(*custom_classes) if custom_classes else F.lit(False), "custom_object")
    index = F.row_number().over(W.partitionBy("source_id").orderBy("ordinal")).cast("long")
    return rows.select("source_id", index.alias("index"), "tag", "node_path", "attributes", key.alias("key"), F.when(key.isNull(), F.col("n_children")).alias("child_count"), is_template(tag).alias("is_template"), data.alias("data_resource_type"))


def is_migratable(nodes: DataFrame) -> Column:
    """Whether a classified node is a visible control: a base control, or a custom one that is no helper by its suffix."""
    return F.col("tag").isin(*BASE_CONTROLS) | ((F.col("classification") == "custom_control") & ~F.lower("tag").rlike(f"({'|'.join(INVISIBLE_SUFFIXES)})$"))


def in_resources() -> Column:
    """Whether a node is a resource scope or below one."""
    return F.col("tag").endswith(".Resources") | F.exists("above", lambda x: x.endswith(".Resources"))


def retention() -> Column:
    """Where a classified node is kept: root_info, control_tree, or separate_inventory for the rest and all below a
    resource scope."""
    control = F.col("tag").isin(*BASE_CONTROLS) | (F.col("classification") == "custom_control")
    return F.when(F.col("classification") == "page_or_document_root", "root_info").when(control & ~in_resources(), "control_tree").otherwise("separate_inventory")


def inventory(classified: DataFrame) -> DataFrame:
    """Every node with where it is kept."""
    return classified.select("source_id", "node_path", "line", "tag", "classification", retention().alias("retention"))


def levels(nodes: DataFrame, keep: str) -> DataFrame:
    """nodes (depth, keep, ...) with `level`: of kept nodes how many kept ones lie above them, null of others.

    Nodes must come as xml_nodes gives them, a document's one after another in one task, and all of them, so nothing is
    shuffled: a task holds a number for each depth."""

    def run(batches):
        above = [0]
        for b in batches:
            out = []
            for depth, kept in zip(b.column("depth").to_pylist(), b.column(keep).to_pylist(), strict=True):
                if depth + 1 == len(above):
                    above.append(0)
                above[depth + 1] = above[depth] + bool(kept)
                out.append(above[depth] if kept else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "level"])

    return nodes.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema] + ["level long"]))


def control_tree(classified: DataFrame) -> DataFrame:
    """(source_id, ordinal, new_parent, tag, node_path) of visible controls outside resource scopes, each below its nearest
    kept ancestor; several roots get one of their own, with ordinal -1 and the first one's tag."""
    from loomspark.operators.trees import splice

    rows = classified.where(~in_resources())
    kept = splice(rows.withColumnRenamed("source_id", "page_id"), is_migratable(rows)).withColumnRenamed("page_id", "source_id")
    roots = kept.where("new_parent is null").groupBy("source_id").agg(F.count("*").alias("roots"), F.min_by("tag", "ordinal").alias("first"))
    several = roots.where("roots > 1")
    held = kept.join(several.select("source_id", F.lit(-1).cast("long").alias("top")).hint("merge"), "source_id", "left")
    moved = held.select("source_id", "ordinal", F.coalesce("new_parent", "top").alias("new_parent"), "tag", "node_path")
    return moved.unionByName(several.select("source_id", F.lit(-1).cast("long").alias("ordinal"), F.lit(None).cast("long").alias("new_parent"), F.col("first").alias("tag"), F.lit("").alias("node_path")))


def subtree(nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path and all below it."""
    return nodes.where((F.col("node_path") == path) | F.col("node_path").startswith(f"{path}/"))


def name_variants(file_name: Column, file_path: Column) -> Column:
    """The distinct spellings under which a file may be referred to."""
    stem = lambda x: F.regexp_replace(x, r"(?<=[^./])\.[^./]*$", "")
    base = lambda x: F.regexp_extract(x, r"([^/]*)$", 1)
    name, path = F.coalesce(file_name, F.lit("")), F.coalesce(file_path, F.lit(""))
    part = F.substring_index(path, ";component/", -1)
    plain = F.array(name, F.lower(name), F.upper(name), stem(name), F.lower(stem(name)), F.upper(stem(name)))
    none = F.array().cast("array<string>")
    by_path = F.when((path != "") & (path != name), F.array(base(path), F.lower(base(path)), stem(base(path)), F.lower(stem(base(path))))).otherwise(none)
    by_part = F.when(path.contains(";component/"), F.array(part, base(part), stem(base(part)))).otherwise(none)
    return F.array_distinct(F.concat(plain, by_path, by_part))


def translate(nodes: DataFrame, renames: dict[str, str]) -> DataFrame:
    """(source_id, text): a document's tree as nested tags under their new names, indented by depth; a tag without a
    rule is a Box that names it. A document's nodes, in order, are one group: it is one text in the end."""
    table = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))
    new = table[F.col("tag")]
    row = F.struct("ordinal", "depth", F.coalesce(new, F.lit("Box")).alias("name"), F.when(new.isNull(), F.concat(F.lit(' data-unsupported="'), F.col("tag"), F.lit('"'))).otherwise("").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = nodes.where("error is null").groupBy("source_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    begin = F.expr("struct(cast(array() as array<string>) as lines, cast(array() as array<string>) as open)")
    closing = lambda stack, depth: F.transform(F.sequence(F.size(stack), depth + 1, F.lit(-1)), lambda i: F.concat(F.repeat(F.lit("  "), i - 1), F.lit("</"), F.element_at(stack, i), F.lit(">")))
    closed = lambda stack, depth: F.when(F.size(stack) > depth, closing(stack, depth)).otherwise(F.array().cast("array<string>"))

    def step(acc: Column, x: Column) -> Column:
        head = F.concat(F.repeat(F.lit("  "), x["depth"]), F.lit("<"), x["name"], x["mark"], F.lit(">"), x["text"])
        stack = F.concat(F.slice(acc["open"], F.lit(1), x["depth"]), F.array(x["name"]))
        return F.struct(F.concat(acc["lines"], closed(acc["open"], x["depth"]), F.array(head)).alias("lines"), stack.alias("open"))

    whole = F.aggregate("rows", begin, step, lambda acc: F.array_join(F.concat(acc["lines"], closed(acc["open"], F.lit(0))), "\n"))
    return grouped.select("source_id", whole.alias("text"))


def unruled(renames: dict[str, str]) -> Column:
    """Whether `translate` has no rule for a node."""
    return ~F.col("tag").isin(*renames)


def placeholders(nodes: DataFrame, renames: dict[str, str]) -> DataFrame:
    """(source_id, node_path, tag) of the nodes that `translate` has no rule for."""
    return nodes.where(F.col("error").isNull() & unruled(renames)).select("source_id", "node_path", "tag")


#: Simple renames of tags.
RENAMES = {
    "Border": "Box", "Canvas": "Box", "ContentControl": "Box", "DockPanel": "Box", "Ellipse": "Box", "Frame": "Box", "Grid": "Box", "GroupBox": "Box", "ItemsControl": "List", "Label": "Typography",
    "ListBox": "List", "ListBoxItem": "ListItem", "ListView": "List", "MenuItem": "MenuItem", "ProgressBar": "LinearProgress", "Rectangle": "Box", "ScrollViewer": "Box", "Separator": "Divider",
    "Slider": "Slider", "TabItem": "Tab", "TextBlock": "Typography", "ToolBar": "Stack", "Viewbox": "Box", "WrapPanel": "Stack",
}
