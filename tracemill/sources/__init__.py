"""Readers and writers of logs, object-centric logs and nets."""

from ..log import Classifier
from .csv import read_csv, sniff, write_csv
from .fingerprint import fingerprints, mismatches
from .notation import parse_notation
from .ocel import read_ocel
from .pnml import read_pnml, write_pnml
from .transition_text import parse_transition_system, transition_system_text
from .xes import read_xes, read_xes_header, write_xes

__all__ = ["Classifier", "fingerprints", "mismatches", "parse_notation", "parse_transition_system", "read_csv", "read_ocel", "read_pnml", "read_xes", "read_xes_header", "sniff", "transition_system_text", "write_csv", "write_pnml", "write_xes"]
