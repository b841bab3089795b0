"""Operators over edge lists, graphs, trees and states."""
