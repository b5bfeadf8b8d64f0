"""Paper repository URLs: routing by host and path, PDF addresses, file names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .text import let, strip

# Fixed value: how an identifier stands in a path.
IDENTIFIER = r"/(?:abs|pdf|html)/([\w.-]+/?\d+|\d+\.\d+)"


@dataclass(frozen=True)
class Repository:
    """One repository: what it serves, how its PDF path comes about (pattern, replacement), how files are named (pattern, groups to join)."""

    domain: str
    hosts: tuple[str, ...]
    paths: str
    pdf: tuple[str, str] | None
    names: tuple[tuple[str, str], ...]


# The repositories in order of priority.
REPOSITORIES = (
    Repository("arxiv", ("arxiv.org",), r"/(abs|pdf|html)/(\d+\.\d+|[\w-]+/\d+)", (r"/(?:abs|html)/", "/pdf/"), ((IDENTIFIER, "arxiv-$1.pdf"),)),
    Repository("openreview", ("openreview.net",), r"/(forum|pdf|attachment)", None, ()),
    Repository("acl", ("aclanthology.org",), r"/\d{4}\.\w+-\w+\.\d+|/[A-Z]\d{2}-\d{4}", (r"/([^/]+)\z", "/$1.pdf"), ((r"/([^/]+?)(?:\.pdf)?\z", "acl-$1.pdf"),)),
    Repository("biorxiv", ("biorxiv.org",), r"/content/10\.1101/", (r"/content/(10\.1101/[\d.]+)((?:v\d+)?)(?:\.full\.pdf|\.full|\z)", "/content/$1$2.full.pdf"), ((r"10\.1101/([\d.]+)", "biorxiv-$1.pdf"),)),
    Repository("medrxiv", ("medrxiv.org",), r"/content/10\.1101/", (r"/content/(10\.1101/[\d.]+)((?:v\d+)?)(?:\.full\.pdf|\.full|\z)", "/content/$1$2.full.pdf"), ((r"10\.1101/([\d.]+)", "medrxiv-$1.pdf"),)),
    Repository(
        "neurips", ("papers.nips.cc", "papers.neurips.cc"), r"/paper/|/paper_files/paper/", (r"(/paper(?:_files/paper)?/\d{4})/hash/([^/]+)-Abstract\.html", "$1/file/$2-Paper.pdf"),
        ((r"/paper(?:_files/paper)?/(\d{4})/(?:hash|file)/([^/-]+)", "neurips-$1-$2.pdf"), (r"/(?:hash|file)/([^/-]+)", "neurips-$1.pdf")),
    ),
    Repository("mlrp", ("proceedings.mlr.press",), r"/v\d+/[a-z0-9]+", (r"/(v\d+)/([a-z0-9]+)(?:\.html)?\z", "/$1/$2/$2.pdf"), ((r"/v(\d+)/([a-z0-9]+)", "mlrp-v$1-$2.pdf"),)),
)


def is_url(value: Column) -> Column:
    return F.lower(strip(value)).rlike(r"\Ahttps?://")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def with_path(url: Column, path: Column) -> Column:
    """The URL with another path; scheme, host, query and fragment stay."""
    head = F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(head, path, F.substring(url, F.length(head) + F.length(path_of(url)) + 1, F.length(url)))


def query_value(url: Column, name: str) -> Column:
    """The first non-empty value of a query field, or null."""
    return F.nullif(F.regexp_extract(url, rf"\?(?:[^#]*&)?{name}=([^&#]+)", 1), F.lit(""))


def host_matches(host: Column, pattern: str) -> Column:
    return (host == pattern) | host.endswith("." + pattern)


def _serves(repository: Repository, u: Column) -> Column:
    hosts = host_matches(u["host"], repository.hosts[0])
    for pattern in repository.hosts[1:]:
        hosts = hosts | host_matches(u["host"], pattern)
    return hosts & u["path"].rlike(repository.paths)


def _by_repository(url: Column, value) -> Column:
    """``value(repository, parts)`` of the first repository that serves the URL; parts: url, host, path, id."""

    def first(u: Column) -> Column:
        out = F
        for repository in REPOSITORIES:
            out = out.when(_serves(repository, u), value(repository, u))
        return out

    return let(F.struct(url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), query_value(url, "id").alias("id")), first)


def repository_of(url: Column) -> Column:
    """The first repository that serves a URL, or null."""
    return _by_repository(url, lambda r, u: F.lit(r.domain))


def is_citable(url: Column) -> Column:
    return F.coalesce(repository_of(url).isNotNull(), F.lit(False))


def _replace_first(text: Column, pattern: str, to: str) -> Column:
    """The text with its first match replaced, or null without one."""

    def replaced(cut: Column) -> Column:
        head, tail = F.get(cut, 0), F.get(cut, 1)
        middle = F.substring(text, F.length(head) + 1, F.length(text) - F.length(head) - F.length(tail))
        return F.when(F.size(cut) == 2, F.concat(head, F.regexp_replace(middle, pattern, to), tail))

    return let(F.split(text, pattern, 2), replaced)


def pdf_url(url: Column) -> Column:
    """The address of a paper's PDF; a URL no repository serves stays as it is."""
    ensured = lambda p: F.when(F.lower(p).endswith(".pdf"), p).otherwise(F.concat(p, F.lit(".pdf")))

    def moved(r: Repository, u: Column) -> Column:
        if r.pdf is None:
            path = F.when(u["id"].isNotNull(), F.lit("/pdf"))
        else:
            path = let(F.coalesce(_replace_first(u["path"], *r.pdf), u["path"]), ensured)
        return F.when(~F.lower(u["path"]).endswith(".pdf"), path)

    return let(F.struct(url.alias("url"), _by_repository(url, moved).alias("path")), lambda m: F.coalesce(with_path(m["url"], m["path"]), m["url"]))


def file_name(url: Column) -> Column:
    """The name a paper's PDF is stored under, or null where no repository serves the URL."""

    def named(r: Repository, u: Column) -> Column:
        if r.domain == "openreview":
            return F.concat(F.lit("openreview-"), F.coalesce(u["id"], F.lit("paper")), F.lit(".pdf"))
        found = []
        for pattern, shape in r.names:
            parts, rest = [], shape
            for k in range(1, shape.count("$") + 1):
                before, rest = rest.split(f"${k}", 1)
                parts += [F.lit(before), F.regexp_extract(u["path"], pattern, k)]
            found.append(F.when(u["path"].rlike(pattern), F.concat(*parts, F.lit(rest))))
        return F.coalesce(*found, F.lit(f"{r.domain}-paper.pdf"))

    return _by_repository(url, named)


def arxiv_id(url: Column) -> Column:
    """The identifier with its version, or null."""
    return F.when(host_matches(host_of(url), "arxiv.org"), F.nullif(F.regexp_extract(path_of(url), IDENTIFIER, 1), F.lit("")))


def without_version(identifier: Column) -> Column:
    return F.regexp_replace(identifier, r"v\d+\z", "")
