"""Declared schemas. Nothing is inferred at run time."""

from __future__ import annotations

SOURCE_ROWS = (
    "county string, source string, source_rank int, row_pos bigint, school string, program string, level string, "
    "year int, status string, points double"
)
COUNTIES = (
    "fylke string, code string, round string, rights string, free_choice boolean, levels string, note string, "
    "round_note string, source string"
)
WORDS = "doc string, page int, text string, x0 double, x1 double, top double, bottom double, fontname string"
REGISTER = "code string, nob string, nno string, eng string"
ENTITIES = "orgnr string, navn string, fylke string, lat double, lon double, url string, adresse string"
CANDIDATES = "school string, fylke string, pos int, tier string, url string, url_big string, why string, alt string"
REQUESTS = (
    "ts timestamp_ntz, method string, ip string, origin string, type string, message string, email string, website string"
)
#: The nested form: a cell is a number or a status, so its value stays text at this edge.
DATASET = (
    "counties array<struct<fylke:string,round:string>>, years array<int>, schools array<struct<name:string,fylke:string,"
    "catchment:boolean,programs:array<struct<program:string,level:string,category:string,values:map<string,string>>>>>"
)
