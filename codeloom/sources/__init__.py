"""Reading source trees and stored graphs."""
