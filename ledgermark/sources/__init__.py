"""Readers and writers for JSON arrays, JSONL trees and result tables."""
