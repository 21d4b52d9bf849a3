"""Parameter trees stored as XML text: parsed by Spark's own XML functions only where a column of theirs is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions import cv

_CV = "cvParam array<struct<_accession string, _name string, _value string, _cvRef string, _unitAccession string, _unitName string>>"
_USER = "userParam array<struct<_name string, _value string, _type string>>"
_TEXT = "userText array<struct<_name string, _VALUE string>>"
#: A parameter tree may wrap its lists (cvParams, userParams, userTexts) or hold the params itself.
TREE = f"cvParams struct<{_CV.replace(' ', ':', 1)}>, userParams struct<{_USER.replace(' ', ':', 1)}>, userTexts struct<{_TEXT.replace(' ', ':', 1)}>, {_CV}, {_USER}, {_TEXT}"


def param_tree(xml: Column) -> Column:
    """A struct of the arrays cv, user and text; empty arrays for what is missing, null for null."""
    t = F.from_xml(xml, TREE)
    either = lambda a, b: F.coalesce(a, b, F.array())
    return F.when(
        xml.isNotNull(),
        F.struct(either(t["cvParams"]["cvParam"], t["cvParam"]).alias("cv"), either(t["userParams"]["userParam"], t["userParam"]).alias("user"), either(t["userTexts"]["userText"], t["userText"]).alias("text")),
    )


def cv_param(tree: Column, accession: str) -> Column:
    """The value of the first param with the accession, or null."""
    return F.get(F.filter(tree["cv"], lambda p: p["_accession"] == accession), 0)["_value"]


def cv_params(tree: Column, accessions: list[str]) -> Column:
    """All params with one of the accessions, in the order of the document."""
    return F.filter(tree["cv"], lambda p: p["_accession"].isin(*accessions))


def user_param(tree: Column, name: str) -> Column:
    """The value of the first user param with the name, or null."""
    return F.get(F.filter(tree["user"], lambda p: p["_name"] == name), 0)["_value"]


def _of(path: str, accession: str) -> str:
    return f"{path}/cvParam[@accession='{accession}']/@value"


def _number(xml: Column, path: str) -> Column:
    return F.get(F.xpath(xml, F.lit(path)), 0).try_cast("double")


_PARAMS = "struct<cvParam:array<struct<_accession:string,_value:string>>>"
_PRECURSOR = f"isolationWindow:{_PARAMS},selectedIonList:struct<selectedIon:array<{_PARAMS}>>,activation:{_PARAMS}"
#: A precursor list, or one precursor as the root.
PRECURSORS = f"precursor array<struct<{_PRECURSOR}>>, {_PRECURSOR.replace('isolationWindow:', 'isolationWindow ', 1).replace(',selectedIonList:', ', selectedIonList ').replace(',activation:', ', activation ')}"


def precursors(xml: Column) -> Column:
    """The first precursor of a precursor list: isolation window (ends as target minus and plus its offsets), selected
    ion, charge, activation and collision energy; null for null. The text is parsed once."""

    def read(p: Column) -> Column:
        first = F.get(p["precursor"], 0)
        either = lambda name: F.coalesce(first[name], p[name])
        value = lambda own, accession: F.get(F.filter(own["cvParam"], lambda c: c["_accession"] == accession), 0)["_value"].try_cast("double")
        window, activation = either("isolationWindow"), either("activation")
        ion = F.get(either("selectedIonList")["selectedIon"], 0)
        target = value(window, cv.ISOLATION_TARGET)
        names = F.create_map(*[F.lit(x) for pair in cv.ACTIVATIONS.items() for x in pair])
        known = F.filter(F.transform(activation["cvParam"], lambda c: F.try_element_at(names, c["_accession"])), lambda k: k.isNotNull())
        return F.struct(
            target.alias("target_mz"),
            (target - value(window, cv.ISOLATION_LOWER)).alias("min_mz"),
            (target + value(window, cv.ISOLATION_UPPER)).alias("max_mz"),
            value(ion, cv.SELECTED_ION_MZ).alias("selected_mz"),
            value(ion, cv.CHARGE_STATE).cast("int").alias("charge"),
            F.get(known, 0).alias("activation"),
            value(activation, "MS:1000045").alias("energy"),
        )

    # a lambda binds the parsed text, which plain references would parse again for each field
    return F.when(xml.isNotNull(), F.get(F.transform(F.array(F.from_xml(xml, PRECURSORS)), read), 0))


def scans(xml: Column) -> Column:
    """Of a scan list: number of scans, start time in seconds (minutes are turned), filter string and the first scan
    window's ends; null for null."""
    start = f"//scan[1]/cvParam[@accession='{cv.SCAN_START_TIME}']"
    unit = F.get(F.xpath(xml, F.lit(start + "/@unitAccession")), 0)
    time = _number(xml, start + "/@value") * F.when(unit == cv.MINUTES, 60.0).otherwise(1.0)
    return F.when(
        xml.isNotNull(),
        F.struct(
            F.xpath_int(xml, F.lit("count(//scan)")).alias("n"),
            time.alias("time"),
            F.get(F.xpath(xml, F.lit(_of("//scan[1]", cv.FILTER_STRING))), 0).alias("filter"),
            _number(xml, _of("//scan[1]//scanWindow[1]", "MS:1000501")).alias("min_mz"),
            _number(xml, _of("//scan[1]//scanWindow[1]", "MS:1000500")).alias("max_mz"),
        ),
    )


def components(xml: Column) -> Column:
    """A component list: kind (source, analyzer, detector), order and first param name of each, by kind."""
    part = lambda kind: F.arrays_zip(F.xpath(xml, F.lit(f"//{kind}/@order")).alias("order"), F.xpath(xml, F.lit(f"//{kind}/cvParam[1]/@name")).alias("name"))
    named = lambda kind: F.transform(part(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["order"].try_cast("int").alias("order"), x["name"].alias("name")))
    return F.when(xml.isNotNull(), F.concat(named("source"), named("analyzer"), named("detector")))


def ms_level(tree: Column, has_precursor: Column) -> Column:
    """The level param, else 2 with and 1 without precursors."""
    return F.coalesce(cv_param(tree, cv.MS_LEVEL).try_cast("int"), F.when(has_precursor, 2).otherwise(1))


def escaped(value: Column) -> Column:
    """Text as XML character data or an attribute's value."""
    out = value
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cv_element(accession: str, name: str, value: Column) -> Column:
    return F.concat(F.lit(f'<cvParam cvRef="MS" accession="{accession}" name="{name}" value="'), escaped(value.cast("string")), F.lit('"/>'))


def user_element(name: str, value: Column, kind: str = "xsd:string") -> Column:
    return F.concat(F.lit(f'<userParam name="{name}" value="'), escaped(value.cast("string")), F.lit(f'" type="{kind}"/>'))


def tree_xml(cvs: list[Column], users: list[Column]) -> Column:
    """A parameter tree as XML text; values are escaped."""
    return F.concat(F.lit("<params><cvParams>"), *cvs, F.lit("</cvParams><userParams>"), *users, F.lit("</userParams></params>"))


def component_list(parts: list[tuple[str, int, Column]]) -> Column:
    """A component list as XML text: (kind, order, name of its param) of each part; values are escaped."""
    one = lambda kind, order, name: F.concat(F.lit(f'<{kind} order="{order}"><cvParam name="'), escaped(name.cast("string")), F.lit(f'"/></{kind}>'))
    return F.concat(F.lit(f'<componentList count="{len(parts)}">'), *[one(*p) for p in parts], F.lit("</componentList>"))


def file_content_xml(tree: Column, source_files: list[tuple[str, str, str]]) -> Column:
    """A file's content as XML text: its parameter tree and its source files (id, name, location); values are escaped."""
    one = lambda k, n, p: F.concat(F.lit('<sourceFile id="'), escaped(F.lit(k)), F.lit('" name="'), escaped(F.lit(n)), F.lit('" location="'), escaped(F.lit(p)), F.lit('"/>'))
    files = F.concat(F.lit(f'<sourceFileList count="{len(source_files)}">'), *[one(*f) for f in source_files], F.lit("</sourceFileList>"))
    return F.concat(F.lit("<fileDescription><fileContent>"), tree, F.lit("</fileContent>"), files, F.lit("</fileDescription>"))


def clean_characters(value: Column) -> Column:
    """Characters that XML 1.0 doesn't allow as U+FFFD."""
    return F.regexp_replace(value, r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "�")
