from tallyline.streaming.intake import first_seen, start_document_stream, start_invoice_intake, start_keyed_intake, stream_archives

__all__ = ["first_seen", "start_document_stream", "start_invoice_intake", "start_keyed_intake", "stream_archives"]
