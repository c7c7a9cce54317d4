"""Condition trees and their compilation to Columns."""
