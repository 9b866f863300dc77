"""Where data comes from: Maildir trees and the adapters for the driver tables."""
