"""Readers of source trees and packages."""
