"""A mail client for streams under test, of the mailbox file that the options name."""

from tests.test_mail_import import Client


def from_options(options):
    return Client(options["box"])
