"""File kinds by extension, and which files may hold text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of the kinds that are known not to be plain text, of logs and of markup.
KIND_EXTENSIONS = {
    "log": "log clef trace tlog err out etl",
    "markup": "html htm xhtml mht mhtml shtml",
    "document": "pdf doc docx docm dot dotx xls xlsx xlsm xlsb ppt pptx pptm odt ods odp rtf epub msg eml one vsd vsdx pub_doc xps oxps",
    "archive": "zip 7z rar tar gz tgz bz2 tbz xz txz zst lz lz4 cab jar war ear nupkg vsix apk ipa whl egg crx xpi msix appx wim esd",
    "disk_image": "vhd vhdx vmdk vdi qcow2 iso img avhdx vmrs vmcx vsv bin_img dmg raw",
    "media": "jpg jpeg png gif bmp tif tiff webp heic ico psd ai mp3 wav flac aac ogg m4a wma mp4 mkv avi mov wmv webm m4v mpg mpeg flv 3gp ttf otf woff woff2 eot",
    "binary": "exe dll sys ocx cpl scr drv efi mui pdb lib obj o a so dylib winmd msi msp msu pyc pyd class wasm node com ax tlb res dmp mdmp hdmp evtx evt etl_bin pf cat nls xex ngen ni map_bin",
    "database": "db sqlite sqlite3 db3 s3db mdb accdb mdf ldf ndf bak dbf ibd frm myd myi rdb aof ldb sst idb i64 id0 id1 nam til edb sdb dat_db pst ost chk jrs",
}
#: Extensions that tell text, code and data apart; all three are text, as is what no list names. A parameter, since languages come and go.
TEXT_EXTENSIONS = {
    "text": "txt md markdown rst adoc text ini cfg conf config properties env toml nfo readme lst asc srt vtt tsv diff patch license 1 man editorconfig gitignore gitattributes dockerignore npmignore",
    "code": "cs vb fs c h cpp cc cxx hpp hh rs go java kt scala py pyi rb php pl pm lua js mjs cjs jsx ts tsx swift m mm dart sql ps1 bat cmd sh bash zsh fish r jl groovy gradle cmake mk asm s pas hs ml v proto css scss less vue sln csproj props targets",
    "data": "json jsonl ndjson xml xsd xsl xslt yaml yml csv plist manifest resx settings reg har geojson wsdl svg rdf owl ttl jsonc json5 inf ics vcf pem crt cer key pub",
}
TEXT_KINDS = ("text", "code", "data", "log", "markup", "unknown")
#: Containers whose members are listed.
LISTED_ARCHIVES = "zip jar war ear nupkg vsix apk ipa whl egg xpi msix appx"


def kind_of(extension: Column, text_extensions: Mapping[str, str] = TEXT_EXTENSIONS) -> Column:
    out = None
    for kind, names in {**text_extensions, **KIND_EXTENSIONS}.items():
        test = extension.isin(names.split())
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def is_text_candidate(extension: Column) -> Column:
    """Whether a file may hold text: unless its kind says otherwise."""
    return ~F.coalesce(extension, F.lit("")).isin([e for k, names in KIND_EXTENSIONS.items() if k not in TEXT_KINDS for e in names.split()])
